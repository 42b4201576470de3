"""Places, running sums, smallest rows and order statistics over all rows, with no task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored

#: Prefix of a hexadecimal key that rows are counted by, and bins and rows up to which a range of numbers is looked at as a whole.
PREFIX, BINS, FEW = 4, 4096, 100_000


def numbered(rows: DataFrame, order: Sequence[str], groups: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """rows with `place`, from 0 by order within their group, and with a value `before`, its sum over the group's earlier rows.

    Rows are sorted by ranges, so a group may span many tasks. What precedes a task's rows of a group is a sum over (group, task)
    pairs, of which there are no more than groups and tasks together. Rows that tie in everything may take each other's place.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*groups, *order]
    at = stored(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())).withColumn("__task", F.shiftright("__at", 33))
    sums = [F.sum(value).alias("__sum")] if value else []
    spans = at.groupBy(*groups, "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), *sums)
    counted = ["__n", *(["__sum"] if value else [])]
    if groups:
        earlier = W.partitionBy(*groups).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
        spans = spans.select(*groups, "__task", "__first", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in counted])
    else:  # a row a task
        found, so_far = [], [0] * len(counted)
        for r in sorted(spans.collect(), key=lambda r: r["__task"]):
            found.append((r["__task"], r["__first"], *so_far))
            so_far = [a + r[c] for a, c in zip(so_far, counted, strict=True)]
        kinds = ", ".join(f"`__{c}` {spans.schema[c].dataType.simpleString()}" for c in counted)
        spans = F.broadcast(rows.sparkSession.createDataFrame(found, f"`__task` long, `__first` long, {kinds}"))
    same = F.col("a.__task") == F.col("s.__task")
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"s.{g}"))
    met = at.alias("a").join(spans.alias("s"), same).select("a.*", *[F.col(f"s.{c}").alias(c) for c in ("__first", *(f"__{c}" for c in counted))])
    out = [*rows.columns, (F.col("__at") - F.col("__first") + F.col("____n")).alias("place")]
    if value:
        inside = W.partitionBy(*groups, "__task").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)  # a task's rows of a group
        out.append((F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("____sum")).alias("before"))
    return met.select(*out)


def smallest(rows: DataFrame, group: str, key: Column, n: int, then: Sequence[str] = ()) -> DataFrame:
    """The n rows of each of a few groups with the smallest hexadecimal key, `then` in order.

    Rows are counted by the key's first digits, which shows from which on none can be among the n; only what is left is sorted.
    """
    keyed = rows.withColumn("__k", key).withColumn("__p", F.substring("__k", 1, PREFIX))
    last: dict = {}
    for r in keyed.groupBy(group, "__p").count().orderBy(group, "__p").collect():  # 16 ** PREFIX rows a group at most
        seen, cut = last.get(r[0], (0, ""))
        last[r[0]] = (seen + r["count"], r["__p"] if seen < n else cut)
    kind = rows.schema[group].dataType.simpleString()
    cuts = rows.sparkSession.createDataFrame([(g, cut) for g, (_, cut) in last.items()], f"`__g` {kind}, `__cut` string")
    left = keyed.join(F.broadcast(cuts), F.col(group).eqNullSafe(F.col("__g"))).where(F.col("__p") <= F.col("__cut"))
    place = F.row_number().over(W.partitionBy(group).orderBy("__k", *then))
    return left.withColumn("__r", place).where(F.col("__r") <= n).select(*rows.columns)


def _statistic(rows: DataFrame, column: str, rank: int, low: float, high: float, n: int) -> float:
    """The value that `rank` values precede: ranges are cut into bins until one is a value, or holds few rows."""
    v = F.col(column)
    while low < high:
        inside = rows.where(v.between(low, high))
        if n <= FEW:
            for r in inside.groupBy(v.alias("v")).count().orderBy("v").collect():
                if rank < r["count"]:
                    return r["v"]
                rank -= r["count"]
        bin_ = F.least(F.lit(BINS - 1), F.floor((v - low) / (high - low) * BINS))
        for r in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("b").collect():
            if rank < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            rank -= r["n"]
    return low


def quantile(rows: DataFrame, column: str, q: float) -> float | None:
    """The exact q-quantile of the values that are not null, between two of them by linear interpolation; None without any."""
    known = rows.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high, n = known.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    at = (n - 1) * q
    below, above = int(at), min(n - 1, int(at) + 1)
    a = _statistic(known, "v", below, low, high, n)
    if at == below:
        return a
    b = _statistic(known, "v", above, low, high, n)
    return a if a == b else (below + 1 - at) * a + (at - below) * b
