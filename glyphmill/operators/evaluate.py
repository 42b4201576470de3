"""Detection metrics as aggregates: ROC, rates per method and subset, audits, shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..plans import ordering


def by_score(rows: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, s, pos, neg): labels counted at each distinct score; nulls left out. All that follows needs only this."""
    y = F.col(label).cast("int")
    return rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*groups, F.col(score).alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


#: Ranges that scores are dealt into, so that sums over all lower scores need no task that sees them all.
RANGES = 256


def cumulated(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """by_score with below_pos and below_neg: the labels at all lower scores of the group.

    Scores are dealt into ranges of about equal size. Sums of whole ranges are few; a window over the scores of one
    range adds the rest.
    """
    bounds = counts.agg(F.percentile_approx("s", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(20 * RANGES)).alias("__b"))
    ranged = counts.crossJoin(F.broadcast(bounds)).withColumn("__r", T.bisect(F.coalesce(F.size("__b"), F.lit(0)), lambda k: F.get(F.col("__b"), k) >= F.col("s"))).drop("__b")
    whole = ranged.groupBy(*groups, "__r").agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    earlier = W.partitionBy(*groups).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)  # RANGES rows of a group at most
    before = whole.select(*groups, "__r", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in ("pos", "neg")])
    within = W.partitionBy(*groups, "__r").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__in_{c}") for c in ("pos", "neg")])
    same = F.lit(True)
    other = before.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__r").alias("__q"), "__pos", "__neg")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    both = summed.join(other, same & (F.col("__r") == F.col("__q")))
    return both.select(*groups, "s", "pos", "neg", (F.col("__pos") + F.col("__in_pos")).alias("below_pos"), (F.col("__neg") + F.col("__in_neg")).alias("below_neg"))


def auroc(rows: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, auroc, n): the chance that a positive outscores a negative, ties half; null unless both classes occur."""
    t = cumulated(by_score(rows, score, label, groups), groups)
    agg = [F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0")]
    return t.groupBy(*groups).agg(*agg).select(*groups, _area().alias("auroc"), (F.col("n1") + F.col("n0")).alias("n"))


def _area() -> Column:
    return F.col("u") / F.nullif((F.col("n1") * F.col("n0")).cast("double"), F.lit(0.0))


def roc(rows: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, threshold, tpr, fpr) at each distinct score, calling it and all above positive."""
    counts = by_score(rows, score, label, groups)
    sums = counts.groupBy(*groups).agg(F.sum("pos").alias("__n1"), F.sum("neg").alias("__n0"))
    t, same = cumulated(counts, groups), F.lit(True)
    whole = F.broadcast(sums.select(*[F.col(g).alias(f"__h_{g}") for g in groups], "__n1", "__n0")) if not groups else sums.select(*[F.col(g).alias(f"__h_{g}") for g in groups], "__n1", "__n0")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__h_{g}"))
    rate = lambda n, c: (F.col(n) - F.col(f"below_{c}")) / F.nullif(F.col(n), F.lit(0))
    return t.join(whole, same).select(*groups, F.col("s").alias("threshold"), rate("__n1", "pos").alias("tpr"), rate("__n0", "neg").alias("fpr"))


def tpr_at_fpr(rows: DataFrame, score: str, label: str, groups: Sequence[str] = (), fpr: float = 0.01) -> DataFrame:
    """(groups, tpr, threshold): the best true-positive rate with a false-positive rate of at most fpr, and the highest score that reaches it."""
    best = F.max(F.when(F.col("fpr") <= fpr, F.struct("tpr", "threshold")))
    return roc(rows, score, label, groups).groupBy(*groups).agg(best.alias("b")).select(*groups, F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"), F.col("b.threshold").alias("threshold"))


def accuracy(p: Column, label: Column, at: float = 0.5) -> Column:
    return F.avg(((p >= at) == (label == 1)).cast("int"))


def log_loss(p: Column, label: Column, eps: float = 1e-6) -> Column:
    return F.avg(-(label * F.ln(p + eps) + (1 - label) * F.ln(1 - p + eps)))


def rates(rows: DataFrame, methods: Sequence[str], subsets: dict[str, Column], label: str, at: float = 0.65) -> DataFrame:
    """(subset, method, n, fpr, tpr) for every pair; subsets may overlap, so rows are spread by flags, once."""
    named = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("p")) for m in methods])
    inside = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in subsets.items()]), lambda x: x.isNotNull())
    long = rows.select(F.explode(inside).alias("subset"), F.col(label).alias("y"), named.alias("m")).select("subset", "y", F.explode("m").alias("m")).select("subset", "y", "m.method", "m.p").where("p is not null")
    hit = (F.col("p") >= at).cast("int")
    return long.groupBy("subset", "method").agg(F.count("*").alias("n"), F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"), F.avg(F.when(F.col("y") == 1, hit)).alias("tpr"))


def audit(rows: DataFrame, group: str, p: str, high: float = 0.65, medium: float = 0.35) -> DataFrame:
    """(group, n, flagged_pct, uncertain_pct, mean_p) without rows of null p."""
    pct = lambda at: F.round(F.avg((F.col(p) >= at).cast("int")) * 100, 1)
    return rows.where(F.col(p).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), pct(high).alias("flagged_pct"), pct(medium).alias("uncertain_pct"), F.round(F.avg(p), 3).alias("mean_p"))


def one_against_rest(rows: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """(against, auroc, n) of each group's positives against all negatives.

    Negatives are counted by score once, with what lies below each score, and the groups' positives look their score up:
    no negative is copied for a group.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    below = cumulated(by_score(known, score, label)).select("s", "neg", "below_neg")
    own = known.where(F.col(label) == 1).groupBy(F.col(group).alias("against"), F.col(score).alias("s")).agg(F.count("*").alias("pos"))
    area = own.join(below, "s").groupBy("against").agg(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"))
    negatives = F.broadcast(known.agg(F.sum((F.col(label) == 0).cast("int")).cast("long").alias("n0")))
    return area.crossJoin(negatives).select("against", _area().alias("auroc"), (F.col("n1") + F.col("n0")).alias("n"))


def logit_shift(rows: DataFrame, p: str, label: str, fpr: float = 0.01, at: float = 0.65) -> DataFrame:
    """(quantile, shift): what to add to the intercept so that only fpr of the negatives reach `at`; quantile by linear interpolation."""
    q = ordering.quantile(rows.where(F.col(label) == 0), p, 1 - fpr)
    ln = lambda x: F.ln(x / (1 - x))
    return rows.sparkSession.createDataFrame([(q,)], "quantile double").withColumn("shift", ln(F.lit(at)) - ln(F.col("quantile")))


def class_guard(rows: DataFrame, group: str, label: str, least: int = 2) -> DataFrame:
    """(group, n, classes) of groups with `least` distinct labels or more."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes")).where(F.col("classes") >= least)


def standardised(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rows with z_<col>: minus mean, over population deviation plus 1e-9."""
    stats = F.broadcast(rows.agg(*[f(c).alias(f"__{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))]))
    return rows.crossJoin(stats).select(*rows.columns, *[((F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-9)).alias(f"z_{c}") for c in cols])
