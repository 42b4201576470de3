"""op1: many equal vectors, more than a block reranks; each query among them gets the smallest ids."""

import numpy as np
import pytest

from glyphmill.llm import vector_search


@pytest.mark.parametrize("rows, equal", [(6000, 1500), (900, 900)])
def test_equal_vectors_settle_by_id(spark, rows, equal):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((rows, 16)).astype(np.float32)
    ids = rng.permutation(rows)
    same = np.sort(ids[:equal])
    x[:equal] = 3.0 * x[0] / np.linalg.norm(x[0])
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in vector_search.op1_vector_search(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    place = {int(i): v for i, v in zip(ids, x.astype(float), strict=True)}
    for q in [i for i in same.tolist() if i % 20 == 0]:
        best = sorted(((-float(place[int(i)] @ place[q]), int(i)) for i in ids if i != q))[:20]
        assert [v for _, v, _ in sorted(got[q])] == [i for _, i in best]


def test_tied_rough_scores_are_all_reranked(spark, monkeypatch):
    """Vectors that share every code but differ: no candidate is left out for its place."""
    monkeypatch.setattr(vector_search, "CODES", 1)
    monkeypatch.setattr(vector_search, "MAX_LISTS", 1)
    monkeypatch.setattr(vector_search, "RERANK", 5)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.op1_vector_search(table).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        assert found == np.argsort(-s, kind="stable")[:20].tolist()
