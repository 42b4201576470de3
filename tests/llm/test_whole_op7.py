"""Texts that hold the mark of a space."""

from glyphmill.llm import piece_codec
from glyphmill.llm.queries import TOKENIZER


def test_mark_of_a_space_does_not_round_trip(spark):
    rows = spark.createDataFrame([(1, "a▁b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.round_trip for r in piece_codec.op7_piece_codec(rows, TOKENIZER).collect()} == {1: False, 2: True, 3: True}
