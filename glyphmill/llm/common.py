"""Session and table helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import session

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale directory; always read through Spark, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; checkpoints go there too."""
    found = session.shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; what is built on them survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes the fast built-in; the rest is translated."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text) of each row. Rows of one id with different texts stay apart by the key, a hash of the text."""
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__text"))


def quoted(name: str) -> str:
    """A column name as Spark parses it, whatever it holds."""
    return f"`{name.replace('`', '``')}`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def beside(columns: list[str], *made: str) -> list[str]:
    """The columns that none of made replaces; like Spark, names that differ in case only are the same."""
    gone = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in gone]


def packed(rows: DataFrame, old: list[str], *more: Column):
    """(rows with the columns of old under plain names and more beside them, how to get a result's own names back).

    Functions over Arrow batches take no names that hold dots or backticks, and so never see the caller's.
    """
    names = {c: f"_{i}" for i, c in enumerate(old)}
    plain = rows.select(*[column(c).alias(n) for c, n in names.items()], *more)
    return plain, lambda out, *made: out.select(*[F.col(n).alias(c) for c, n in names.items()], *made)


#: Rows of one key from which a join sends that key's other side to every task, and how many such keys there may be.
HOT_ROWS, HOT_KEYS = 2_000, 1 << 16


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with keyed, which has one row a key and in column n how many of the `total` rows have that key.

    A key that holds HOT_ROWS rows and a HOT_KEYSth of all or more is broadcast, so its rows stay where they are; by
    counting there are HOT_KEYS such keys at most. The others meet in a shuffle, where none is large.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    others = [c for c in keyed.columns if c not in on]
    hot = keyed.where(F.col(n) >= least).select(*on, F.struct(*others).alias("__hot"))
    split = rows.join(F.broadcast(hot), on, "left")
    still = split.where(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col("__hot")[c].alias(c) for c in others])
    moved = split.where(F.col("__hot").isNull()).select(*rows.columns).join(keyed.where(F.col(n) < least), on).select(*rows.columns, *others)
    return still.union(moved)
