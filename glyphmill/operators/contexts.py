"""Words of many texts as numbers, dealt out by the word before them, so that what has to meet moves a part at a time.

A model of back-off counts brings together all places of a word sequence. Done at once, every word of the corpus is on
disk several times, as a row of strings. Here texts are scanned once, words become 64-bit numbers, which are checked to be
all different, and rows of numbers are written in parts by their context; a part's exchanges are gone before the next one
begins.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..session import shared_dir

#: Words of a part times the words before each, while parts are few enough, and parts at most: each one costs a few jobs.
PART, PARTS = 1 << 23, 32
#: A word that is more than one in so many is a context of several shares.
SHARES = 256
#: What stands before a text's first word; no word is empty.
BEGIN = ""


def code(word: Column, seed: int) -> Column:
    """The number of a word."""
    return F.xxhash64(F.lit(seed), word)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session for a while; names with _ for the dots."""
    names = {k: k.replace("_", ".") for k in values}
    before = {k: spark.conf.get(names[k], None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(names[k]) if v is None else spark.conf.set(names[k], v)


@dataclass
class Folder:
    """Tables of one computation in the shared folder, each dropped when it is done with."""

    spark: SparkSession
    path: str

    def put(self, name: str, table: DataFrame, *by: str, some_keys: bool = False) -> DataFrame:
        """table, written and read again; what its exchanges left on disk goes. some_keys: rows that are together by some of a join's keys stay where they are."""
        more = {"spark_sql_requireAllClusterKeysForCoPartition": "false"} if some_keys else {}
        with settings(self.spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_maxConcurrentOutputFileWriters=str(2 * PARTS if by else 0), **more):
            table.write.option("compression", "lz4_raw").partitionBy(*by).parquet(f"{self.path}/{name}")
        return self.read(name, table)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass
class Dealt:
    """words: (w, n), the number and count of each, `total` of `types`; parts of rows (id, v, w), with two words before (id, u, v, s, w); begin: the number of BEGIN.

    A part has all rows of its words v. Frequent ones have several shares s of what stands before them, `shares` (v, shares) says how many.
    """

    folder: Folder
    id_col: str
    words: DataFrame
    total: int
    types: int
    begin: int
    parts: int
    shares: DataFrame
    rows: DataFrame

    def part(self, i: int) -> DataFrame:
        # the folder is listed anew, as parts go when they are done
        out = self.folder.read("rows", self.rows).where(F.col("part") == i).drop("part")
        # said here, so that all who read the part have the same filters and share one exchange
        return out.where(" AND ".join(f"{c} IS NOT NULL" for c in out.columns if c != self.id_col))

    def count(self) -> Column:
        """Number of rows, by the id, so that the exchange below is the one that brings the ids."""
        return F.count(self.id_col) + F.count_if(F.col(self.id_col).isNull())

    def means(self, looked: Callable[[DataFrame, int], DataFrame], together: list[str], keys: list[str]) -> DataFrame:
        """(id, n, ppl, xppl): rows with a ppl, and means, of what looked(rows, part) has for them: (*keys, ppl, xppl), of unique keys. Rows come dealt by the columns of together.

        Parts are summed up here, one after the other; a single one when the result is asked for.
        """

        def sums(i: int) -> DataFrame:
            rows = self.part(i).repartition(*together)
            return rows.join(looked(rows, i).hint("shuffle_hash"), keys).groupBy(self.id_col).agg(F.count("ppl").alias("n"), F.sum("ppl").alias("ppl"), F.sum("xppl").alias("xppl"))

        out = sums(0)
        if self.parts > 1:
            for i in range(self.parts):
                self.folder.put(f"sums/part={i}", sums(i), some_keys=together != keys)
                self.folder.drop(f"rows/part={i}")
            out = self.folder.read("sums", out)
        mean = lambda c: (F.sum(c) / F.sum("n")).alias(c)
        return out.groupBy(self.id_col).agg(F.sum("n").alias("n"), mean("ppl"), mean("xppl")).where("n > 0")


def dealt(docs: DataFrame, before: int, id_col: str = "doc_id", text_col: str = "text") -> Dealt:
    """The words of docs with one or two before them, dealt by the one before. With two, a text's first word counts as well."""
    spark = docs.sparkSession
    folder = Folder(spark, f"{shared_dir(spark)}/contexts-{uuid.uuid4().hex}")
    lists = folder.put("lists", docs.select(id_col, T.lower_words(F.col(text_col)).alias("l")))
    for seed in itertools.count():
        # a number that two words or BEGIN share shows in another hash of theirs
        other = lambda c: code(c, -1 - seed)  # noqa: B023, E731
        found = lists.select(F.explode("l").alias("w")).select(code(F.col("w"), seed).alias("w"), other(F.col("w")).alias("o"))
        words = folder.put(f"words-{seed}", found.groupBy("w").agg(F.count("*").alias("n"), (F.min("o") != F.max("o")).alias("clash")))
        begin = spark.range(1).select(code(F.lit(BEGIN), seed)).first()[0]
        total, types, clashes = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("clash") | (F.col("w") == begin))).first()
        if not clashes:
            break
        folder.drop(f"words-{seed}")
    words = words.drop("clash")
    parts = max(1, min(PARTS, -(-total * before // PART)))
    shares = folder.put("shares", words.where(F.col("n") * SHARES > total).select(F.col("w").alias("v"), F.ceil(F.col("n") * SHARES / total).cast("int").alias("shares")).coalesce(1))
    shifted = [F.concat(F.array(*[F.lit(BEGIN)] * k), F.col("l")) for k in range(before, 0, -1)]
    names = ["u", "v", "w"][2 - before :]
    made = lists.select(id_col, F.inline_outer(F.arrays_zip(*shifted, F.col("l"))).alias(*names)).where("w is not null")
    made = made.select(id_col, *[code(F.col(c), seed).alias(c) for c in names])
    if before > 1:
        made = made.join(F.broadcast(shares), "v", "left").select(id_col, "u", "v", F.coalesce(F.pmod("u", "shares"), F.lit(0)).cast("int").alias("s"), "w")
    else:
        made = made.where(F.col("v") != begin)
    rows = folder.put("rows", made.withColumn("part", F.pmod("v", F.lit(parts)).cast("int")), "part")
    folder.drop("lists")
    return Dealt(folder, id_col, words, total, types, begin, parts, shares, rows)
