"""Workers outlive stages: what one operator keeps there must not stand beside the next one's work."""

import pyarrow as pa

from glyphmill.llm import piece_codec, wordblocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_the_codec_stays_for_its_own_tasks_and_goes_with_another_operators():
    with open(MODEL, "rb") as f:
        model = f.read()
    codec = piece_codec._codec(model)
    batch = pa.RecordBatch.from_pydict({"text": ["una casa", None, "otra casa"]})
    assert [b.num_rows for b in piece_codec._encode_map(model, "text")([batch])] == [3]
    assert piece_codec._codec(model) is codec and codec.cache
    assert [b.num_rows for b in wordblocks.pieces([batch], "text")] == [3]
    assert not wordblocks.KEPT
    assert piece_codec._codec(model) is not codec
