"""Fits: calibration, the stacked model, out-of-fold scores. Penalised as 0.5 |w|^2 + sum of losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..functions import scores as S
from .evaluate import auroc, logit_shift, tpr_at_fpr


def _logistic(rows: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> tuple[list[float], float]:
    n = rows.count()
    if rows.select(label).distinct().count() < 2:
        raise ValueError("both classes are needed")
    made = VectorAssembler(inputCols=list(cols), outputCol="__x").transform(rows)
    fit = LogisticRegression(featuresCol="__x", labelCol=label, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10, **({"weightCol": weight} if weight else {})).fit(made)
    return [float(x) for x in fit.coefficients], float(fit.intercept)


def fit_calibration(rows: DataFrame, score: str, label: str, model_id: str, fpr: float = 0.01) -> dict:
    """slope, intercept, threshold_low_fpr and metrics of P(machine) from a score where low means machine."""
    used = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"), (-F.col(score)).alias("m"))
    (slope,), intercept = _logistic(used, ["s"], "y")
    at, area = tpr_at_fpr(used, "m", "y", fpr=fpr).first(), auroc(used, "m", "y").first()
    return {"model_id": model_id, "slope": slope, "intercept": intercept, "threshold_low_fpr": None if at["threshold"] is None else round(-at["threshold"], 4), "metrics": {"auroc": round(area["auroc"], 4), "tpr_at_1pct_fpr": round(at["tpr"], 4), "n": area["n"]}}


def fit_meta(rows: DataFrame, cols: Sequence[str], label: str) -> dict:
    """coef, intercept, mean, std of a balanced stacked model over standardised columns."""
    s = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n"), F.sum(label).alias("p")).first()
    mean, std = [float(s[f"m{i}"]) for i in range(len(cols))], [float(s[f"s{i}"]) + 1e-9 for i in range(len(cols))]
    balanced = F.when(F.col(label) == 1, s["n"] / (2.0 * max(s["p"], 1))).otherwise(s["n"] / (2.0 * max(s["n"] - s["p"], 1)))
    z = rows.select(F.col(label).cast("double").alias("y"), balanced.alias("w"), *[((F.col(c) - mean[i]) / std[i]).alias(f"z{i}") for i, c in enumerate(cols)])
    coef, intercept = _logistic(z, [f"z{i}" for i in range(len(cols))], "y", "w")
    return {"features": list(cols), "coef": coef, "intercept": intercept, "mean": mean, "std": std}


def score_meta(rows: DataFrame, fitted: dict, out: str = "meta_p") -> DataFrame:
    array = lambda k: F.array(*[F.lit(float(x)) for x in fitted[k]])
    return rows.withColumn(out, S.stacked([F.col(c) for c in fitted["features"]], array("coef"), F.lit(float(fitted["intercept"])), array("mean"), array("std")))


def out_of_fold(rows: DataFrame, cols: Sequence[str], label: str, fold: str = "fold", k: int = 5) -> DataFrame:
    """rows with meta_p, each scored by a model fitted on the other folds."""
    out = None
    for i in range(k):
        part = score_meta(rows.where(F.col(fold) == i), fit_meta(rows.where(F.col(fold) != i), cols, label))
        out = part if out is None else out.unionByName(part)
    return out


def fixed_weights(rows: DataFrame, lm_p: str, classifier_p: str, style: str, out: str = "fixed_p") -> DataFrame:
    """rows with the probability of the fixed weights, the baseline that a stacked model is held against."""
    return rows.withColumn(out, S.combine(F.col(lm_p), F.col(classifier_p), F.col(style)))


def compare_features(rows: DataFrame, base: Sequence[str], extra: Sequence[str], label: str, fold: str = "fold", k: int = 5) -> DataFrame:
    """(features, auroc, tpr, n) of out-of-fold scores of a stacked model with the base columns and with the extra ones too."""
    out = None
    for name, cols in (("base", base), ("with extra", [*base, *extra])):
        scored = out_of_fold(rows, cols, label, fold, k)
        line = auroc(scored, "meta_p", label).crossJoin(tpr_at_fpr(scored, "meta_p", label).select("tpr")).select(F.lit(name).alias("features"), "auroc", "tpr", "n")
        out = line if out is None else out.unionByName(line)
    return out


def shifted(fitted: dict, scored: DataFrame, label: str, p: str = "meta_p", fpr: float = 0.01, at: float = 0.65) -> dict:
    """The fit with its intercept moved so that only fpr of people reach `at`."""
    shift = logit_shift(scored, p, label, fpr, at).first()["shift"]
    return fitted | {"intercept": fitted["intercept"] + float(shift), "intercept_shift": float(shift)}
