"""Partitioning of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer: small files would leave cores idle.

    Large inputs have more splits than cores and pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def gathered(files: DataFrame, times: int = 16) -> DataFrame:
    """files with `times` partitions as one, if that leaves two for each core: a partition counts each file as 4 MB at least, so it holds 32 small ones at most."""
    least = 2 * files.sparkSession.sparkContext.defaultParallelism
    n = files._jdf.queryExecution().toRdd().getNumPartitions()
    return files.coalesce(max(least, -(-n // times))) if n > least else files
