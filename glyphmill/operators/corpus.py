"""Corpus building: filters, cleaning, deduplication, sampling and splits, all deterministic by hash."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .. import lexicon as L
from ..functions import text as T
from ..plans import ordering
from ..session import ship, stored
from . import matching


def draw(*parts: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) from an MD5 of the parts: the same in every engine and run."""
    return F.conv(F.substring(key(*parts, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def key(*parts: Column | str, seed: int = 42) -> Column:
    """An MD5 of the parts and the seed: a random order that anyone can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]).cast("binary"))


def stratified(rows: DataFrame, label: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """min(rows of the class, n / 2) rows of each of two classes, by hash."""
    return ordering.smallest(rows, label, key(id_col, seed=seed), n // 2, [id_col])


def first_of_text(rows: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """The first row of each text; the order says which is first. Texts meet as digests, and each task sends one row of a text."""
    first = F.min_by(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]), F.struct(*order))
    return rows.groupBy(F.md5(F.col(text).cast("binary")).alias("__digest")).agg(first.alias("__row")).select("__row.*")


def group_split(rows: DataFrame, group: str, share: float = 0.3, seed: int = 42, hold_out: Column | None = None) -> DataFrame:
    """rows with split (train, test): whole groups go together; groups that the hold-out touches are test."""
    test = draw(group, seed=seed) < share
    if hold_out is not None:
        touched = rows.where(hold_out).select(F.col(group).alias("__g")).distinct().withColumn("__h", F.lit(True))
        rows = rows.join(touched, F.col(group) == F.col("__g"), "left")
        test = test | F.coalesce("__h", F.lit(False))
    return rows.withColumn("split", F.when(test, "test").otherwise("train")).drop("__g", "__h")


#: Rows of groups of a TOP-th of all rows or more stay where they are; there are no more than TOP such groups.
TOP = 10_000


def _turns(loads: list[int], size: int, groups: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, end, folds) of spans of groups of one size, by place: their folds follow each other in turn. loads takes them up.

    Dealt each to the fold of least load, the first of equals, groups of one size go in the order of (load + j * size, fold): by
    whole sizes in the load, in rounds of the folds that have reached that level, by what is left over within a round.
    """
    out, level = [], [x // size for x in loads]
    order = sorted(range(len(loads)), key=lambda i: (loads[i] % size, i))
    steps, first = sorted(set(level)), 0
    for low, high in zip(steps, [*steps[1:], None], strict=True):
        turn = [i for i in order if level[i] <= low]
        end = groups if high is None else min(groups, first + (high - low) * len(turn))
        rounds, rest = divmod(end - first, len(turn))
        for k, i in enumerate(turn):
            loads[i] += size * (rounds + (k < rest))
        if end > first:
            out.append((size, first, end, turn))
        first = end
    return out


def folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """rows with fold (0 to k - 1): groups, largest first and then in order, go each to the fold that has least. A null group is a group.

    Groups of one size take turns that their places among each other decide (see _turns), so the driver sees a row for each
    size that occurs, of which n rows make no more than the root of 2n, and all else is numbering and joins.
    """
    sizes = stored(rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n")))
    loads, spans = [0] * k, []
    for r in sizes.groupBy("n").agg(F.count("*").alias("groups")).orderBy(F.desc("n")).collect():
        spans += _turns(loads, r["n"], r["groups"])
    turns = F.broadcast(rows.sparkSession.createDataFrame(spans, "n long, first long, end long, turn array<int>"))
    at = F.col("place") - F.col("first")
    placed = ordering.numbered(sizes, ["g"], ["n"]).join(turns, "n").where(F.col("place").between(F.col("first"), F.col("end") - 1))
    placed = stored(placed.select(F.col("g").alias("__g"), F.get("turn", (at % F.size("turn")).cast("int")).alias("__f"), F.col("n").alias("__n")))
    same, large = F.col(group).eqNullSafe(F.col("__g")), F.col("__n") * TOP >= sum(loads)
    split = rows.join(F.broadcast(placed.where(large).select("__g", "__f")), same, "left")
    more = split.where("__f is null").select(*rows.columns).join(placed.where(~large), same)
    result = lambda met: met.select(*rows.columns, F.col("__f").alias("fold"))
    return result(split.where("__f is not null")).unionByName(result(more))


def hashed_folds(rows: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """folds without a global order, for groups too many to rank."""
    return rows.withColumn("fold", F.floor(draw(group, seed=seed) * k).cast("int"))


def choose_task(id_col: str, seed: int = 42, weights: Sequence[tuple[str, float]] = L.TASK_WEIGHTS) -> Column:
    """One of the tasks by weight."""
    u, so_far, out = draw(id_col, F.lit("task"), seed=seed), 0.0, None
    for name, w in weights[:-1]:
        so_far += w
        out = F.when(u < so_far, name) if out is None else out.when(u < so_far, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def prompt(item_id: str, text: str, title: str, field: str, domain: str, words: str, task: Column, seed: int = 42) -> Column:
    """The prompt of a task; words are clamped to 150 to 600, variants are chosen by hash."""
    n = F.greatest(F.lit(150), F.least(F.col(words), F.lit(600))).cast("string")
    pick = lambda options, salt: F.element_at(F.array(*[F.lit(x) for x in options]), F.floor(draw(item_id, F.lit(salt), seed=seed) * len(options)).cast("int") + 1)

    def fill(template: Column, **values: Column) -> Column:
        for k, v in values.items():
            template = F.replace(template, F.lit("{" + k + "}"), v)
        return template

    para = F.concat(fill(pick(L.PARAPHRASE_PROMPTS, "variant"), words=n), F.lit("\n\n"), F.col(text))
    academic = fill(F.lit(L.PROMPT_ACADEMIC), words=n, genre=pick(L.GENRES, "genre"), field=F.col(field), title=F.col(title))
    base = F.when(F.col(domain) == "academico", academic).otherwise(fill(F.lit(L.PROMPT_ENCYCLOPEDIC), words=n, title=F.col(title)))
    human = F.when(task == "humanizar", F.concat(base, F.lit(L.PROMPT_HUMANISE))).otherwise(base)
    return F.when(task == "parafrasear", para).otherwise(F.concat(human, F.lit(L.PROMPT_END)))


def reject_reason(c: Column, least: int = 100) -> Column:
    """corto, idioma, or null for a text that may stay."""
    return F.when(T.count_blank_words(c) < least, "corto").when(~T.is_spanish(c), "idioma")


def accepted_items(items: DataFrame, domain: str, source: str, least: int = 150, most: int | None = 600) -> DataFrame:
    """(id, text, domain, title, field, year, source, words): Spanish items of least to most words, one per id.

    items: (id, text, title, field, year and, if it differs by item, source), whatever crawl or dump they come from.
    """
    n = T.count_blank_words(F.col("text"))
    rows = items.where(F.col("text").isNotNull()).dropDuplicates(["id"]).withColumn("words", n).where(F.col("words") >= least)
    if most is not None:
        rows = rows.where(F.col("words") <= most)
    rows = rows.where(T.is_spanish(F.col("text"))).withColumn("domain", F.lit(domain))
    rows = rows.withColumn("source", F.coalesce("source", F.lit(source)) if "source" in rows.columns else F.lit(source))
    return rows.select("id", "text", "domain", "title", "field", "year", "source", "words")


def human_items(items: DataFrame, domain: str, source: str, target: int, least: int = 150, most: int | None = 600) -> DataFrame:
    """`target` of the accepted items, by hash."""
    return accepted_items(items, domain, source, least, most).orderBy(key("id"), "id").limit(target)


def article_text(parts: DataFrame, id_col: str = "id", limit: int = 650) -> DataFrame:
    """(id, text) of articles from (id, k, text) paragraphs, up to the first that passes `limit` words; residues are stripped then."""
    sized = parts.withColumn("n", T.count_blank_words(F.col("text")))
    kept = take_until(sized, id_col, "k", "n", limit).withColumn("text", T.wiki_residue(F.col("text")))
    return kept.groupBy(id_col).agg(T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n")).alias("text"))


def oversample(rows: DataFrame, times: int, where: Column) -> DataFrame:
    """rows with those that match `where` `times` times over."""
    copies = F.when(where, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies))


def shuffled(rows: DataFrame, *by: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(key(*by, seed=seed))


def take_until(rows: DataFrame, id_col: str, order: str, size: str, limit: int) -> DataFrame:
    """Parts of each id in order, up to and without the first that takes the running total past limit."""
    up = W.partitionBy(id_col).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("__t", F.sum(size).over(up)).where(F.col("__t") <= limit).drop("__t")


def pending(jobs: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Jobs that are not done yet: what a resumed run still has to do."""
    return jobs.join(done.select(*on).distinct(), list(on), "left_anti")


def split_rejects(rows: DataFrame, text: str, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason)."""
    judged = rows.withColumn("reason", reject_reason(F.col(text), least))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def aligned_union(*frames: DataFrame, columns: Sequence[str]) -> DataFrame:
    """UNION ALL of the named columns; what a frame lacks is null."""
    out = None
    for f in frames:
        have = f.select(*[c for c in columns if c in f.columns])
        out = have if out is None else out.unionByName(have, allowMissingColumns=True)
    return out.select(*columns)


#: Bytes of texts in a range of lengths, about.
RANGE_BYTES = 64 << 20


def by_length(rows: DataFrame, text: str, partitions: int) -> DataFrame:
    """Rows in ranges of similar length, sorted within, so batches of a model pad little.

    There are as many ranges as asked for, and more where one would be larger than RANGE_BYTES; rows of one length may lie in several.
    """
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(partitions, -(-total // RANGE_BYTES))
    return rows.repartitionByRange(n, F.length(text), F.xxhash64(*rows.columns)).sortWithinPartitions(F.length(text))


def length_class(size: Column) -> tuple[Column, Column]:
    """(number, largest size) of the class of sizes that differ by an eighth at most; numbers rise with sizes."""
    bits = F.length(F.bin(size.cast("long"))) - 1
    shift = F.greatest(bits - 3, F.lit(0))
    step = F.call_function("shiftright", size.cast("long"), shift)  # below 16
    most = F.call_function("shiftleft", (step + 1).cast("long"), shift) - 1
    return (shift * 16 + step).cast("int"), most


def padded_batches(rows: DataFrame, size: Column, budget: int, order: str) -> DataFrame:
    """rows with size, class, batch: batches of rows of similar size that a model pads to the longest, rows times longest within budget.

    Batches never mix classes of sizes; within a class rows go by size, then by `order`, as many to a batch as the class's
    largest size allows (one if even that is too much). Batches are numbered within their class.
    """
    number, most = length_class(F.col("size"))
    sized = rows.withColumn("size", size).withColumn("class", number)
    placed = ordering.numbered(sized, ["size", order], ["class"])
    held = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(most, F.lit(1))))
    return placed.withColumn("batch", F.floor(F.col("place") / held).cast("long")).drop("place")


def _changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """(change, kept, length_ratio) of pairs of texts, one by one: a worker holds the words of one pair, not of a batch."""
    def one(*pair: str | None) -> tuple[float, float, float]:
        before, after = (re.findall(r"\w+", t.lower()) if isinstance(t, str) else [] for t in pair)
        n, both, least = matching.matched(before, after), len(before) + len(after), max(len(before), 1)
        return (1 - 2 * n / both if both else 0.0), n / least, len(after) / least  # two empty texts are the same

    return pd.DataFrame(np.array([one(*pair) for pair in zip(a, b, strict=True)], float).reshape(-1, 3), columns=["change", "kept", "length_ratio"])


def rewrite_change(original: str, rewritten: str):
    """Struct (change, kept, length_ratio) of a rewrite against its original, over lower-case words; a Pandas UDF, by matching.blocks."""
    ship(SparkSession.active())
    return F.pandas_udf(_changes, "change double, kept double, length_ratio double")(F.col(original), F.col(rewritten))
