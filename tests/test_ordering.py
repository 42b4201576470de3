"""Places, sums, samples, order statistics, folds and batches against plain Python, and that no task sees all rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import corpus as C, evaluate as E
from glyphmill.plans import ordering
from glyphmill.sources import sinks

SKEWED = [("hot", 5000), ("warm", 1500), *[(f"g{i}", 1 + i % 7) for i in range(800)], (None, 9)]


def test_places_and_sums(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab") if i % 50 else None, rng.randrange(1000), i, rng.randrange(5)) for i in range(3000)]
    rows = spark.createDataFrame(data, "g string, k int, id int, v int").repartition(7)
    got = {r.id: r for r in ordering.numbered(rows, ["k", "id"], ["g"], "v").collect()}
    whole = {r.id: r for r in ordering.numbered(rows, ["k", "id"], value="v").collect()}
    by = defaultdict(list)
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        by[r[0]].append(r)
        by["all"].append(r)
    for g, own in by.items():
        found = whole if g == "all" else got
        for place, r in enumerate(own):
            assert (found[r[2]].place, found[r[2]].before) == (place, sum(x[3] for x in own[:place]))


def test_the_plan_of_places_has_no_single_task(spark):
    plan = ordering.numbered(spark.range(100), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


@pytest.mark.parametrize("few, bins", [(100_000, 4096), (10, 4), (1, 2)])
def test_quantiles_are_exact(spark, monkeypatch, few, bins):
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "BINS", bins)
    rng = random.Random(few)
    for values in ([0.25], [1.0, 2.0], [5.0] * 40, [rng.random() for _ in range(101)], [rng.choice([0.1, 0.1 + 1e-17, 0.3, 1e300, -1e300]) for _ in range(60)]):
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "p double")
        for q in (0.0, 0.37, 0.95, 1.0):
            assert ordering.quantile(rows, "p", q) == rows.agg(F.percentile("p", F.lit(q))).first()[0]
    assert ordering.quantile(rows.where("p is null"), "p", 0.5) is None
    assert E.logit_shift(rows.withColumn("y", F.lit(1)), "p", "y").first().shift is None


@pytest.mark.parametrize("prefix", [1, 4])
def test_samples_are_the_smallest_keys(spark, monkeypatch, prefix):
    monkeypatch.setattr(ordering, "PREFIX", prefix)
    rows = spark.createDataFrame([(i, i % 2 if i % 100 else None) for i in range(2000)], "id int, y int").withColumn("key", C.key("id"))
    got = C.stratified(rows, "y", "id", 100).collect()
    data = rows.collect()
    for y in (0, 1, None):
        assert {r.id for r in got if r.y == y} == {r.id for r in sorted((r for r in data if r.y == y), key=lambda r: r.key)[:50]}
    assert C.stratified(rows, "y", "id", 0).count() == 0 and C.stratified(rows.limit(0), "y", "id", 10).count() == 0


def test_first_of_a_text_that_a_third_of_rows_share(spark):
    data = [(i, "same" if i % 3 == 0 else None if i % 50 == 1 else f"t{i // 4}", f"s{i % 5}") for i in range(600)]
    rows = spark.createDataFrame(data, "id int, text string, `so.urce` string").repartition(6)
    got = sorted((r.id, r.text, r["so.urce"]) for r in C.first_of_text(rows, "text", ["id"]).collect())
    first = {}
    for r in data:
        first.setdefault(r[1], r)
    assert got == sorted(first.values())


@pytest.mark.parametrize("top", [10_000, 20])
def test_folds_are_even_and_keep_groups_together(spark, monkeypatch, top):
    monkeypatch.setattr(C, "TOP", top)
    rows = spark.createDataFrame([(g, i) for g, n in SKEWED for i in range(n)], "g string, i int").repartition(5)
    dealt = C.folds(rows, "g", 3)
    got = dealt.groupBy("g", "fold").count().collect()
    assert len(got) == len(SKEWED) and {(r.g, r["count"]) for r in got} == set(SKEWED)
    loads = Counter()
    for r in got:
        loads[r.fold] += r["count"]
    rest = sum(n for _, n in SKEWED) - 5000
    assert {r.fold for r in got if r.g == "hot"} == {0} and loads[0] == 5000
    assert all(abs(loads[k] - rest / 2) <= 0.01 * rest / 2 for k in (1, 2)) and dealt.columns == ["g", "i", "fold"]


def test_folds_are_greedy(spark):
    rng = random.Random(8)
    sizes = {g: max(1, int(rng.paretovariate(1.1))) for g in range(12_000)} | {12_000: 900, 12_001: 901}
    rows = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n if n < 1000 else 1000)], "g int, i int")
    sizes = {g: min(n, 1000) for g, n in sizes.items()}
    loads, want = [0] * 5, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        want[g] = loads.index(min(loads))
        loads[want[g]] += sizes[g]
    assert {r.g: r.fold for r in C.folds(rows, "g").select("g", "fold").distinct().collect()} == want


def test_batches_cost_no_more_than_allowed(spark):
    rng = random.Random(5)
    sizes = [0, 0, 1, 7, 8, 9, 100_000, *(int(rng.paretovariate(0.8) * 20) for _ in range(3000)), *[333] * 1000]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id int, n int").repartition(6)
    got = C.padded_batches(rows, F.col("n"), 4000, "id").collect()
    assert sorted((r.id, r.n, r.size) for r in got) == [(i, n, n) for i, n in enumerate(sizes)]
    by = defaultdict(list)
    for r in got:
        by[r["class"], r.batch].append(r)
    order = sorted(by)
    assert all(len(own) == 1 or len(own) * max(r.n for r in own) <= 4000 for own in by.values())
    ends = [(max((r.n, r.id) for r in by[a]), min((r.n, r.id) for r in by[b])) for a, b in zip(order, order[1:], strict=False)]
    assert all(a < b for a, b in ends)  # batches follow each other by size, then id
    assert all(r.n <= own[0].n * 1.13 + 1 for own in by.values() for r in own for own in [sorted(own, key=lambda r: r.n)])
    padded, real = sum(len(own) * max(r.n for r in own) for own in by.values()), sum(sizes)
    assert padded < 1.13 * real


def test_a_run_that_dies_leaves_nothing_to_readers(spark, tmp_path):
    path, schema = f"file://{tmp_path}/out", "id long, text string"
    jobs = spark.range(10).select("id")
    work = lambda rows: rows.withColumn("text", F.lit("x"))
    sinks.append_missing(jobs.where("id < 3"), path, ["id"], work, schema)
    # a second run was killed between its files and its commit
    work(jobs.where("id between 3 and 6")).write.json(f"{path}/run=dead")
    (tmp_path / "out" / "_runs" / ".dead").touch()
    assert sinks.read_committed(spark, path, schema).count() == 3
    seen = []

    def noted(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return work(rows)

    for _ in range(2):
        sinks.append_missing(jobs, path, ["id"], noted, schema)
    assert seen == [[3, 4, 5, 6, 7, 8, 9], []]
    assert sorted(r.id for r in sinks.read_committed(spark, path, schema).collect()) == list(range(10))
    assert sinks.sweep(spark, path) == ["run=dead"] and sinks.sweep(spark, path) == []
    assert sinks.read_committed(spark, path, schema).count() == 10


def test_work_that_fails_commits_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    with pytest.raises(Exception, match="boom|raise_error|USER_RAISED"):
        sinks.append_missing(spark.range(4), path, ["id"], lambda rows: rows.select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).cast("string").alias("text")), "id long, text string")
    assert sinks.read_committed(spark, path, "id long, text string").count() == 0


def test_ranges_of_lengths_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_BYTES", 1000, raising=False)
    rows = spark.createDataFrame([(i, "x" * (7 if i % 2 else i % 50)) for i in range(2000)], "id int, text string")
    placed = C.by_length(rows, "text", 4).select(F.spark_partition_id().alias("at"), "id", F.length("text").alias("n")).collect()
    by = defaultdict(list)
    for r in placed:
        by[r.at].append(r.n)
    assert sorted(r.id for r in placed) == list(range(2000)) and max(sum(v) for v in by.values()) < 4000
    assert [n for k in sorted(by) for n in by[k]] == sorted(r.n for r in placed)
