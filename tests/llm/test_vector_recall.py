"""Recall of op1_vector_search where queries lie apart from the other rows, and where few rows are near to all."""

import numpy as np

from glyphmill.llm import vector_search

N, DIM = 20_000, 64


def recall(spark, x: np.ndarray) -> float:
    """Share of the 20 truly nearest rows that are found, by brute force over the vectors as stored."""
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found: dict[int, list[float]] = {}
    for r in vector_search.op1_vector_search(rows).collect():
        found.setdefault(r["query_id"], []).append(r["score"])
    x, shares = x.astype(np.float64), []
    for q in range(0, N, 20):
        score = np.delete(x @ x[q], q)
        last = np.partition(score, -20)[-20]
        shares.append(sum(s >= last - 1e-9 * abs(last) for s in found[q]) / 20)
    return float(np.mean(shares))


def test_queries_apart_from_the_rows(spark):
    r = np.random.default_rng(5)
    centers = r.standard_normal((50, DIM))
    x = centers[r.integers(0, 50, N)] + 0.3 * r.standard_normal((N, DIM))
    x[::20] = 3 * r.standard_normal((N // 20, DIM))
    assert recall(spark, x) > 0.95


def test_rows_that_the_sample_has_not_seen(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SAMPLE_ROWS", 2_000)
    r = np.random.default_rng(4)
    x = 20 * np.eye(DIM)[r.integers(0, DIM, N)] + r.standard_normal((N, DIM))
    x[3_001:N:4_000] = 500 + r.standard_normal((5, DIM))  # among the nearest of nearly all
    assert recall(spark, x) > 0.95
