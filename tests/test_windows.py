"""Windows and chunks of models against one pass over the whole text, and back-off models against sums over the vocabulary."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill import queries as own
from glyphmill.config import EngineConfig
from glyphmill.operators import backoff, signals, windows

TOKENS = "doc_id long, tokens array<struct<token:int,start:int,end:int>>"
SIZES = [0, 1, 2, 63, 64, 65, 66, 512, 513, 514, 576, 577, 1024, 1025, 1026, 1601, 5000]


def texts(sizes=SIZES):
    rng = np.random.default_rng(4)
    return [(i, [(int(x), 3 * k, 3 * k + 2) for k, x in enumerate(rng.integers(1, 20, n))]) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("batch", [1, 700, 1 << 20])
def test_windows_equal_one_pass(spark, batch):
    rows = texts()
    got = windows.window_statistics(spark.createDataFrame(rows, TOKENS), own.recent_lengths, batch_tokens=batch).collect()
    want = []
    for i, tokens in rows:
        if len(tokens) > 1:
            ((ppl, xppl),) = own.recent_lengths()([np.array([t[0] for t in tokens])])
            want += [(i, k, *tokens[k][1:], float(ppl[k - 1]), float(xppl[k - 1])) for k in range(1, len(tokens))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_model_never_sees_more_than_a_window(spark):
    config = EngineConfig(lm_chunk=10, lm_context=4)

    def load():
        def run(batch):
            assert all(2 <= len(x) <= 14 for x in batch)
            return [(np.full(len(x) - 1, len(x)), np.zeros(len(x) - 1)) for x in batch]

        return run

    got = windows.window_statistics(spark.createDataFrame(texts([25]), TOKENS), load, config=config)
    assert [r.ppl for r in got.orderBy("pos").collect()] == [11.0] * 10 + [14.0] * 10 + [8.0] * 4


def test_chunks_equal_the_text_cut_up(spark):
    rows = texts([0, 1, 95, 381, 382, 383, 476, 477, 478, 764, 765, 5000])
    got = {r.doc_id: r.classifier_p for r in windows.text_probability(spark.createDataFrame(rows, TOKENS), own.weighted_lengths).collect()}
    for i, tokens in rows:
        ids = [t[0] for t in tokens]
        chunks = [ids[k : k + 382] for k in range(0, max(len(ids), 1), 382)]
        if len(chunks) > 1 and len(chunks[-1]) < 95:
            chunks[-1] = ids[-382:]
        p = own.weighted_lengths()([np.array(c) for c in chunks])
        assert got[i] is None if not ids else math.isclose(got[i], np.average(p, weights=[len(c) for c in chunks]))


def test_batches_pad_little():
    sizes = np.array([5, 100, 3, 3, 90, 7, 1])
    made = [b.tolist() for b in windows.batches_of(sizes, 20)]
    assert made == [[6, 2, 3, 0], [5], [4], [1]] and sorted(sum(made, [])) == list(range(7))


def test_a_models_own_tokenizer(spark):
    def load():
        return lambda text: [(len(w), text.index(w), text.index(w) + len(w)) for w in text.split()]

    docs = spark.createDataFrame([("a", "uno tres"), ("b", None), ("c", "")], "name string, body string")
    rows = windows.tokenized(docs, load, "name", "body")
    assert {r.name: [tuple(t) for t in r.tokens] for r in rows.collect()} == {"a": [(3, 0, 3), (4, 4, 8)], "b": [], "c": []}
    assert [tuple(r)[:4] for r in windows.window_statistics(rows, own.recent_lengths, "name").collect()] == [("a", 1, 4, 8)]


def kneser_ney(corpus, d=0.75):
    """(p2, p3, vocabulary) by their definitions; the vocabulary holds one unseen word."""
    tri = Counter((u, v, w) for t in corpus for u, v, w in zip(["", "", *t], ["", *t], t, strict=False))
    bi, uni = Counter((v, w) for _, v, w in tri), Counter()
    for _, w in bi:
        uni[w] += 1
    words = [*uni, "\x00"]
    p1 = lambda w: max(uni[w] - d, 0) / sum(uni.values()) + d * len(uni) / sum(uni.values()) / len(words)
    of_v, of_uv, kinds_v, kinds_uv = Counter(), Counter(), Counter(), Counter()
    for (v, _), k in bi.items():
        of_v[v] += k
        kinds_v[v] += 1
    for (u, v, _), c in tri.items():
        of_uv[u, v] += c
        kinds_uv[u, v] += 1
    p2 = lambda v, w: max(bi[v, w] - d, 0) / of_v[v] + d * kinds_v[v] / of_v[v] * p1(w)
    p3 = lambda u, v, w: max(tri[u, v, w] - d, 0) / of_uv[u, v] + d * kinds_uv[u, v] / of_uv[u, v] * p2(v, w)
    return p2, p3, words


def test_back_off_equals_sums_over_the_vocabulary(spark):
    corpus = ["la casa de la loma y la casa de piedra", "de la casa a la loma", "piedra", "", "la la la la", "uno dos"]
    docs = spark.createDataFrame([*enumerate(corpus), (9, None)], "doc_id long, text string")
    p2, p3, words = kneser_ney([t.split() for t in corpus])
    got = defaultdict(dict)
    for r in backoff.backoff_statistics(docs).collect():
        got[r.doc_id][r.pos] = r
    for i, t in enumerate(corpus):
        t = t.split()
        assert set(got[i]) == set(range(1, len(t)))
        for k, r in got[i].items():
            u, v, w = (["", "", *t])[k], t[k - 1], t[k]
            assert math.isclose(sum(p3(u, v, x) for x in words), 1) and math.isclose(sum(p2(v, x) for x in words), 1)
            assert math.isclose(r.ppl, -math.log(p3(u, v, w)), rel_tol=1e-9)
            assert math.isclose(r.xppl, -sum(p2(v, x) * math.log(p3(u, v, x)) for x in words), rel_tol=1e-9)
            assert corpus[i][r.start : r.end] == w


def test_back_off_feeds_the_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    scores = signals.document_scores(backoff.backoff_statistics(docs.select("doc_id", "text")))
    assert scores.where(F.col("lm_score") > 0).count() == docs.where(F.size(F.split("text", r"\s+")) > 1).count()
