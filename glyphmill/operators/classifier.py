"""A supervised classifier of texts trained inside Spark: a stand-in where no neural one is at hand.

Features are byte trigrams dealt into a prime number of buckets, damped and of unit length; the model is logistic. It
is trained as a neural one would be: mini-batches by epoch, decoupled weight decay, linear warm-up and decay, clipped
gradients, and the best of several checkpoints by its figures on topics that training never saw. A step is one job:
tasks add up their rows' gradients, a few more tasks those sums, the driver the rest, so what moves is a vector of
`dim` numbers a task, whatever the number of rows. Which rows make a batch is a hash, so a run can be repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship, stored
from . import corpus as C, evaluate as E

#: Buckets of trigrams; a prime, so that no byte decides a bucket alone.
DIM = 16_381
FEATURES = "array<int>", "array<float>"
#: Features that a Python worker holds at once, whatever a batch's rows; those of one text go together.
MOST = 1 << 19


def trigrams(text: str | None, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's byte trigrams, blanks around it included."""
    raw = np.frombuffer(f" {text or ''} ".encode(), np.uint8).astype(np.int64)
    return np.unique((raw[:-2] * 65536 + raw[1:-1] * 256 + raw[2:]) % dim, return_counts=True) if len(raw) > 2 else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def damped(counts: np.ndarray) -> np.ndarray:
    """log(1 + count), of unit length."""
    out = np.log1p(counts)
    return out / max(float(np.sqrt(np.square(out).sum())), 1e-12)


def featured(docs: DataFrame, keep: Sequence[str], text_col: str = "text", dim: int = DIM) -> DataFrame:
    """The columns of keep, at (buckets) and count of each text."""
    ship(docs.sparkSession)
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda b, lo, n, found: pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, n) for c in keep), *(pa.array(x, pa.list_(pa.int32())) for x in zip(*found, strict=True))], names=[*keep, "at", "count"])
        for b in batches:
            found, held, lo = [], 0, 0
            for k, x in enumerate(b.column("__text")):
                found.append(tuple(v.astype(np.int32) for v in trigrams(x.as_py(), dim)))
                held += len(found[-1][0])
                if held >= MOST or k == b.num_rows - 1:
                    yield whole(b, lo, k + 1 - lo, found)
                    found, held, lo = [], 0, k + 1

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    return rows.mapInArrow(run, f"{kinds}, at array<int>, count array<int>")


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of featured rows, of about MOST features."""
    part = np.cumsum(b.column("at").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // MOST
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(starts, starts[1:], strict=False):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of every feature in a batch."""
    sizes = b.column("at").value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = np.log1p(b.column("count").flatten().to_numpy().astype(float))
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(sizes)))
    return row, b.column("at").flatten().to_numpy(), value / np.maximum(norm, 1e-12)[row]


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class GramClassifier:
    weights: np.ndarray
    bias: float

    def probabilities(self, texts: Sequence[str | None]) -> list[float]:
        out = []
        for text in texts:
            at, count = trigrams(text, len(self.weights))
            out.append(float(_chance(self.weights[at] @ damped(count) + self.bias)))
        return out

    def load(self) -> Callable[[list[str]], list[float]]:
        """For signals.text_provider."""
        return self.probabilities

    def scored(self, rows: DataFrame, keep: Sequence[str], out: str = "p") -> DataFrame:
        """The columns of keep and the probability of featured rows."""
        weights, bias = self.weights, self.bias

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (part for batch in batches for part in _parts(batch)):
                row, at, value = _rows(b)
                z = np.bincount(row, weights=weights[at] * value, minlength=b.num_rows) + bias
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(_chance(z))], names=[*keep, out])

        used = rows.select(*keep, "at", "count")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.schema.fields[: len(keep)])
        return used.mapInArrow(run, f"{kinds}, `{out}` double")

    def artefact(self) -> dict:
        return {"dim": len(self.weights), "bias": self.bias, "weights": self.weights.tolist()}

    @classmethod
    def of(cls, artefact: dict) -> GramClassifier:
        return cls(np.array(artefact["weights"]), float(artefact["bias"]))


def gradient(rows: DataFrame, model: GramClassifier, label: str, smoothing: float = 0.0) -> tuple[np.ndarray, int, float]:
    """(gradient of the mean loss by weights and bias, rows, mean loss) of featured rows."""
    weights, bias, dim = model.weights, model.bias, len(model.weights)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 3)
        for b in (part for batch in batches for part in _parts(batch)):
            row, at, value = _rows(b)
            y = b.column("y").to_numpy() * (1 - smoothing) + smoothing / 2
            p = _chance(np.bincount(row, weights=weights[at] * value, minlength=b.num_rows) + bias)
            off = p - y
            total[:dim] += np.bincount(at, weights=off[row] * value, minlength=dim)
            total[dim:] += off.sum(), b.num_rows, -(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 3)
        for b in batches:
            for raw in b.column("sum").to_pylist():
                total += np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    used = rows.select("at", "count", F.col(label).cast("double").alias("y"))
    spread = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sums = used.mapInArrow(first, "sum binary").repartition(spread).mapInArrow(second, "sum binary").collect()
    total = sum((np.frombuffer(r["sum"]) for r in sums), np.zeros(dim + 3))
    n = int(total[dim + 1])
    return total[: dim + 1] / max(n, 1), n, float(total[dim + 2] / max(n, 1))


class Descent:
    """Adam with decoupled weight decay, clipped gradients, and a rate that rises over the first share of steps and then falls to 0."""

    def __init__(self, dim: int, steps: int, rate: float, decay: float = 0.01, warm: float = 0.06, clip: float = 1.0):
        self.m, self.v, self.t = np.zeros(dim), np.zeros(dim), 0
        self.steps, self.rate, self.decay, self.warm, self.clip = steps, rate, decay, int(warm * steps), clip

    def rate_at(self, t: int) -> float:
        """The rate of step t, from 0."""
        return self.rate * (t / self.warm if t < self.warm else max(0.0, (self.steps - t) / max(1, self.steps - self.warm)))

    def step(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        rate = self.rate_at(self.t)
        g = g * min(1.0, self.clip / (np.linalg.norm(g) + 1e-6))
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return x * (1 - rate * self.decay) - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def judged(rows: DataFrame, model: GramClassifier, label: str) -> dict:
    """auroc, log_loss, sure_share (label 0 at 0.99 or more) and n of featured rows."""
    scored = model.scored(rows, [label])
    p, y = F.col("p"), F.col(label)
    line = scored.agg(E.log_loss(p, y).alias("log_loss"), F.avg(F.when(y == 0, (p >= 0.99).cast("int"))).alias("sure_share"), F.count("*").alias("n")).first()
    return {"auroc": E.auroc(scored, "p", label).first()["auroc"], **line.asDict()}


def trained(docs: DataFrame, label: str, group: str, id_col: str = "doc_id", text_col: str = "text", epochs: int = 4, batches: int = 8, rate: float = 0.5, held: float = 0.15, oversample: int = 1, smoothing: float = 0.0, every: int = 8, seed: int = 0, dim: int = DIM) -> tuple[GramClassifier, list[dict]]:
    """(model, figures of each checkpoint), of rows with a label of 0 or 1.

    Whole groups, a share of `held` of them by hash, judge the checkpoints, one after every `every` steps and at the end: the
    best area under the curve of three digits wins, then the least loss. Without such groups the last step's model stays.
    oversample: how many times over rows of label 1 count, each copy in a batch of its own choice.
    """
    rows = docs.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(group).alias("topic"), F.col(label).cast("int").alias("y"), F.col(text_col).alias("text"))
    split = stored(featured(C.group_split(rows, "topic", held, seed), ["id", "y", "split"], "text", dim), "split")
    train, val = split.where("split = 'train'"), split.where("split = 'test'")
    known = val.agg(F.count_distinct("y")).first()[0] == 2
    copies = C.oversample(train, oversample, F.col("y") == 1)
    descent = Descent(dim + 1, epochs * batches, rate)
    x, best, figures = np.zeros(dim + 1), None, []
    for epoch in range(epochs):
        turn = F.floor(C.draw("id", "copy", F.lit(f"epoch{epoch}"), seed=seed) * batches)
        for k in range(batches):
            g, n, loss = gradient(copies.where(turn == k), GramClassifier(x[:dim], x[dim]), "y", smoothing)
            if n:
                x = descent.step(x, g)
            if known and (descent.t % every == 0 or (epoch, k) == (epochs - 1, batches - 1)):
                model = GramClassifier(x[:dim].copy(), float(x[dim]))
                found = judged(val, model, "y")
                figures.append({"step": descent.t, "loss": loss, **found})
                mark = (round(found["auroc"], 3), -found["log_loss"])
                if best is None or mark > best[0]:
                    best = (mark, model)
    return (best[1] if best else GramClassifier(x[:dim], float(x[dim]))), figures
