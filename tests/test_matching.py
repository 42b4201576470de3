"""Matching blocks against the standard library's, and their time on long repetitive texts."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import corpus as C, matching


@pytest.mark.parametrize("words", [2, 3, 10, 200])
def test_blocks_equal_the_standard_librarys(words):
    rng = random.Random(words)
    for _ in range(150):
        a, b = ([rng.randrange(words) for _ in range(rng.randrange(60))] for _ in range(2))
        if rng.random() < 0.5:  # a rewrite
            b = [rng.randrange(words) if rng.random() < 0.2 else x for x in a if rng.random() < 0.9]
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        merged = []
        for i, j, n in sorted(matching.blocks(a, b)):  # the library joins blocks that touch on both sides
            if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
                merged[-1] = (*merged[-1][:2], merged[-1][2] + n)
            else:
                merged.append((i, j, n))
        assert merged == [tuple(x) for x in want[:-1]]


def test_long_repetitive_texts():
    rng = random.Random(7)
    frequent = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    edited = [x if rng.random() < 0.97 else "x" for x in frequent]
    began = time.perf_counter()
    n = matching.matched(frequent, edited)
    assert 0.9 * len(frequent) < n < len(frequent) and time.perf_counter() - began < 5  # about a second on an idle machine
    assert matching.matched(["a"] * 20_000, ["a"] * 15_000) == 15_000


def test_rewrites(spark):
    texts = [("Uno dos tres", "uno DOS cuatro"), ("", ""), (None, "x"), ("a b c", None), ("a a a b", "b a a")]
    rows = spark.createDataFrame(texts, "a string, b string").select("a", "b", C.rewrite_change("a", "b").alias("r")).select("a", "b", "r.*").collect()
    for r in rows:
        a, b = (r.a or "").lower().split(), (r.b or "").lower().split()
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert r.change == pytest.approx(1 - m.ratio()) and r.length_ratio == len(b) / max(len(a), 1)
        assert r.kept == sum(x.size for x in m.get_matching_blocks()) / max(len(a), 1)
