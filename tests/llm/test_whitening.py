"""op12: eigenvectors, eigenvalues and distances against dense linear algebra and whole numbers, and edge cases."""

from collections import defaultdict

import numpy as np
import pytest

from glyphmill.llm import whitening
from glyphmill.llm.common import table

SCHEMA = "vec_id long, embedding array<float>"


def dense(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    values, columns = np.linalg.eigh(y.T @ y / n)
    return n, sums, x, values[::-1], columns[:, ::-1]


def against(rows, vectors, ids):
    n, sums, x, values, columns = dense(vectors)
    got = defaultdict(list)
    for r in rows:
        got[r.vec_id].append(r)
    kept = min(16, int((values > 1e-12 * values[0]).sum()))
    signs = {}
    assert sorted(got) == sorted(ids)
    for i, own in zip(ids, x, strict=True):
        assert [r.component for r in sorted(got[i], key=lambda r: r.component)] == list(range(1, kept + 1))
        y = (own - sums // n) - (sums % n) / n
        for r in got[i]:
            c = r.component - 1
            want = y @ columns[:, c] / np.sqrt(values[c])
            sign = signs.setdefault(c, np.sign(want * r.whitened) or 1)
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, sums, strict=True))
            assert abs(r.whitened * sign - want) < 1e-7 and abs(r.explained - values[c] / values.sum()) < 1e-10
            assert r.identity_error < 1e-9 and r.residual < 1e-12


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    held = table(spark, d, "embeddings").collect()
    against(whitening.op12_whitening(table(spark, d, "embeddings")).collect(), [r.embedding for r in held], [r.vec_id for r in held])


def test_widening_stops_early_on_steep_spectra(spark):
    rng = np.random.default_rng(5)
    scale = np.concatenate([np.linspace(40, 20, 16), np.full(184, 0.02)])
    vectors = (rng.standard_normal((600, 200)) * scale).round(3).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(5)
    fitted = whitening.fit(whitening.usable(rows, "vec_id", "embedding").select("x").distinct(), 200)
    values = dense(vectors)[3]
    assert fitted.passes <= whitening.PATIENCE + 1 and np.allclose(fitted.values, values[:16], rtol=1e-12) and fitted.residuals.max() < 1e-12


def test_flat_spectra_are_widened_until_exact(spark):
    vectors = np.random.default_rng(6).standard_normal((300, 70)).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    against(whitening.op12_whitening(rows).collect(), vectors, list(range(300)))


def test_copies_nulls_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((40, 3)).tolist() + [[1.0, 2.0, 3.0]] * 60
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0]), (204, []), (205, [1.0]), (206, [1e30, 0.0, 0.0])]
    rows = spark.createDataFrame([*enumerate(vectors), *bad], SCHEMA).selectExpr("*", "1 AS id", "2 AS x", "3 AS Whitened", "4 AS `a``b`")
    against(whitening.op12_whitening(rows).collect(), vectors, list(range(100)))


def test_nothing_to_whiten(spark):
    empty = whitening.op12_whitening(spark.createDataFrame([], SCHEMA))
    alike = whitening.op12_whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA))
    assert empty.columns == alike.columns and empty.collect() == [] and alike.collect() == []
    (row,) = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])], SCHEMA)).collect()
    assert (row.vec_id, row.n, row.deviation, row.whitened) == (None, 1, 0, [])


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_distances_are_exact(shift):
    x = np.array([[shift + 1, 5], [shift + 9, -7], [shift, 0]], np.int64)
    sums = x.sum(axis=0).tolist()
    assert whitening.deviations(x, sums, 3) == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert whitening.deviations(np.array([[0], [1 << 50]], np.int64), [1 << 50], 2) == [None, None]
