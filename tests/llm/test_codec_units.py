"""The codec's work and memory: units are coded side by side, and a worker keeps little of them."""

import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import piece_codec
from glyphmill.llm.queries import TOKENIZER

SYLLABLES = ["an", "ble", "th", "st", "er", "re", "nd", "ou", "ing", "le", "é", "tion"]


def batch(rng, rows):
    word = lambda: "".join(rng.choice(SYLLABLES, rng.integers(3, 7)))
    return pa.RecordBatch.from_pydict({"text": [" ".join(word() for _ in range(100)) for _ in range(rows)]})


@pytest.fixture
def model():
    with open(TOKENIZER, "rb") as f:
        return f.read()


def test_no_call_of_python_for_each_new_word(model):
    rng, calls = np.random.default_rng(3), 0
    run = piece_codec._encode_map(model, "text")
    list(run([batch(rng, 300)]))

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    more = batch(rng, 300)
    new = {w for t in more.column("text").to_pylist() for w in t.split()}
    sys.setprofile(count)
    try:
        got = list(run([more]))
    finally:
        sys.setprofile(None)
    assert all(all(b.column("round_trip").to_pylist()) for b in got)
    assert len(new) > 20_000 and calls < len(new) / 4


def test_a_worker_keeps_few_bytes_of_a_word(model):
    rng = np.random.default_rng(5)
    run = piece_codec._encode_map(model, "text")
    list(run([batch(rng, 10)]))
    more = batch(rng, 1000)
    new = {w for t in more.column("text").to_pylist() for w in t.split()}
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    try:
        for _ in run([more]):
            pass
        kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert len(new) > 60_000 and kept < 120 * len(new)


@pytest.mark.parametrize("cache, at_once, pairs, long", [(1 << 19, 1 << 18, 400_000, 256), (3, 5, 4, 256), (3, 5, 4, 2)])
def test_ids_do_not_depend_on_what_goes_together(model, monkeypatch, cache, at_once, pairs, long):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    for k, v in (("CACHE", cache), ("AT_ONCE", at_once), ("PAIRS", pairs), ("LONG", long)):
        monkeypatch.setattr(piece_codec, k, v)
    codec = piece_codec.Codec(model)
    texts = [None, "", " ", "  a  b ", "\n\n\tx\r\n", "the thing", "日本語 한국어 𝔘 ​", "a▁b ▁", "x" * 700, "the " * 9, "é" * 300 + " é", "#%% &&&"]
    for part in (texts, texts[:1], [], texts[::-1]):
        rows = pa.array(["", *part], pa.string())[1:]
        ids, ends = codec.encode_all(rows)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [lib.encode(t or "") for t in part]
        assert codec.round_trips(rows, ids, ends).tolist() == ["▁" not in (t or "") for t in part]


def test_characters_that_a_model_without_bytes_lacks_are_unknown_once_a_run():
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(TOKENIZER, "rb") as f:
        proto.ParseFromString(f.read())
    kept = [p for p in proto.pieces if p.type != piece_codec.BYTE]
    del proto.pieces[:]
    proto.pieces.extend(kept)
    proto.trainer_spec.byte_fallback = False
    raw = proto.SerializeToString()
    codec, lib = piece_codec.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in ("a\U0001d518\U0001d518b \U0001d518 \U0001d518c", "\U0001d518", "the ​\U0001d518x"):
        assert codec.encode(text).tolist() == lib.encode(text)
