"""The trained stand-in: features, gradients and steps against dense numpy, selection of checkpoints, held-out accuracy."""

import numpy as np
import pytest

from glyphmill import queries as own
from glyphmill.operators import classifier as K, evaluate as E, signals

TEXTS = [f"el perro {i} come pan y queso" if i % 2 else f"the dog {i} eats bread and cheese" for i in range(60)]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, i % 2, f"t{i // 2 % 10}", t) for i, t in enumerate(TEXTS)] + [(98, None, "t1", "x"), (99, 1, None, None)]
    return spark.createDataFrame(data, "doc_id long, y int, topic string, text string").repartition(3)


def dense(text, dim):
    raw = f" {text or ''} ".encode()
    x = np.zeros(dim)
    for i in range(len(raw) - 2):
        x[int.from_bytes(raw[i : i + 3]) % dim] += 1
    x = np.log1p(x)
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def test_features(spark, rows):
    got = {r.doc_id: r for r in K.featured(rows, ["doc_id", "y"], dim=97).collect()}
    for i, t in enumerate(TEXTS):
        x = np.zeros(97)
        x[got[i].at] = K.damped(np.array(got[i]["count"]))
        assert np.allclose(x, dense(t, 97)) and got[i].y == i % 2
    assert got[99].at == [] and got[98].y is None


def test_gradient_equals_dense(rows):
    rng = np.random.default_rng(1)
    model = K.GramClassifier(rng.standard_normal(97), 0.3)
    used = K.featured(rows.where("y is not null"), ["doc_id", "y"], dim=97)
    got, n, loss = K.gradient(used, model, "y", smoothing=0.1)
    x = np.array([dense(t, 97) for t in [*TEXTS, None]])
    y = np.array([*(i % 2 for i in range(60)), 1]) * 0.9 + 0.05
    p = 1 / (1 + np.exp(-(x @ model.weights + 0.3)))
    assert n == 61 and np.allclose(got, np.append(x.T @ (p - y), (p - y).sum()) / 61, atol=1e-9)
    assert np.isclose(loss, -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert np.allclose(model.probabilities([*TEXTS, None]), p)


def test_steps_warm_up_decay_and_clip():
    d = K.Descent(1, steps=100, rate=1.0, decay=0.0)
    assert [d.rate_at(t) for t in (0, 3, 6, 53, 100)] == [0.0, 0.5, 1.0, 0.5, 0.0]
    free, huge = (K.Descent(2, 100, 1.0) for _ in range(2))
    free.t = huge.t = 10
    a, b = free.step(np.zeros(2), np.array([0.6, 0.8])), huge.step(np.zeros(2), np.array([600.0, 800.0]))
    assert np.allclose(a, b, atol=1e-4)  # a gradient above length 1 counts as one of length 1


def test_training_learns_and_keeps_the_best_checkpoint(spark, rows):
    model, figures = K.trained(rows, "y", "topic", epochs=3, batches=4, every=5, held=0.3, oversample=2, dim=4001)
    assert [f["step"] for f in figures] == [5, 10, 12] and figures[-1]["auroc"] == 1.0
    best = max(figures, key=lambda f: (round(f["auroc"], 3), -f["log_loss"]))
    val = K.judged(K.featured(rows.where("y is not null and topic is not null"), ["doc_id", "y"], dim=4001), model, "y")
    assert val["auroc"] == 1.0 and best["sure_share"] >= 0
    again = K.GramClassifier.of(model.artefact())
    out = signals.text_provider(rows.select("doc_id", "text"), again.load, "p", "double").collect()
    assert all((r.p > 0.5) == (r.doc_id % 2 == 1) for r in out if r.doc_id < 60)
    assert np.allclose(sorted(r.p for r in out), sorted(again.probabilities([*TEXTS, "x", None])))


def test_without_validation_topics_the_last_step_stays(rows):
    model, figures = K.trained(rows, "y", "topic", epochs=1, batches=2, held=0.0, dim=97)
    assert figures == [] and np.abs(model.weights).sum() > 0


def test_held_out_documents_are_told_apart(spark):
    scored = own.QUERIES["trained_classifier"](spark, "/root/testdata/sf0.01")
    first = E.auroc(scored, "p", "y").first()
    assert first.n > 50 and first.auroc > 0.9
