"""op13: how much work texts make, and words of odd texts."""

import re

import numpy as np
import pyarrow as pa

from glyphmill.llm import hmm


def test_texts_of_like_lengths_share_steps(monkeypatch):
    monkeypatch.setattr(hmm, "BATCH", 10_000)
    rng = np.random.default_rng(2)
    sizes = np.where(np.arange(3000) % 100 == 0, 1000, rng.integers(5, 15, 3000))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rng.integers(0, 9, ends[-1]).astype(np.int32)))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), ids], names=["key", "ids"])
    steps, seen = 0, {}
    for own, flat, at in hmm._batched([rows]):
        steps += int(np.diff(at).max())
        for k, a, b in zip(own.column("key").to_pylist(), at, at[1:], strict=False):
            seen[k] = flat[a:b].tolist()
    assert seen == dict(enumerate(ids.to_pylist()))
    assert steps < 5000  # long texts fill three batches or four; in the order of rows one is in each of six


def test_tokens_are_words_and_ends():
    texts = [b"The the\x0b THE\n\xc3\x89t\xc3\xa9", b"", None, b"  ", b"a" * 300, b"x\ty\x1fz"]
    words, which, sizes = hmm.tokens(pa.array([b"-", *texts], pa.binary())[1:])
    got = [words[i].as_py() for i in which]
    want = [[*re.findall(rb"[^\x20\x09-\x0d]+", (t or b"").lower()), hmm.END] for t in texts]
    assert got == [w for t in want for w in t] and sizes.tolist() == list(map(len, want))
    assert len(set(words.to_pylist())) == len(words)


def test_a_task_sends_a_word_once(monkeypatch):
    words = [f"w{i}" for i in range(300_000)]
    rows = [pa.RecordBatch.from_pydict({"train": [True], "text": pa.array([" ".join(words).encode()], pa.binary())})] * 2
    sent = list(hmm._count(iter(rows)))
    assert sum(b.num_rows for b in sent) == 300_001
    assert {c for b in sent for c in b.column("c").to_pylist()} == {2}
