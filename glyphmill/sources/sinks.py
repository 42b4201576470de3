"""Outputs: nested JSON reports, partitioned Parquet, resumable appends, rejects, artefacts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.corpus import pending


def report_json(reports: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, json) of nested reports."""
    return reports.select(id_col, F.to_json(F.struct(*[c for c in reports.columns if c != id_col])).alias("json"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def write_split(rows: DataFrame, path: str, by: str = "split") -> None:
    rows.write.mode("overwrite").partitionBy(by).parquet(path)


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the runs that were finished, one JSON lines folder each."""
    return [f"{path}/run={x}" for x in _names(spark, f"{path}/_runs") if not x.startswith(".")]


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all finished runs; what a run that was killed left behind is not read."""
    parts = committed(spark, path)
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)


def append_missing(jobs: DataFrame, path: str, on: Sequence[str], work, schema: str) -> None:
    """work(pending jobs) appended to the JSON lines at path; what a finished run did is not done again.

    A run writes a folder of its own and, when that is whole, notes its name by renaming one file, which happens or does
    not. So a run that dies at any point leaves nothing that readers see, and the next one does its work.
    """
    spark, run = jobs.sparkSession, uuid.uuid4().hex
    work(pending(jobs, read_committed(spark, path, schema), on)).write.json(f"{path}/run={run}")
    fs, part = _files(spark, f"{path}/_runs/.{run}")
    fs.create(part).close()
    if not fs.rename(part, _files(spark, f"{path}/_runs/{run}")[1]):
        raise OSError(f"cannot commit {run} at {path}")


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove what unfinished runs left; only while no other run is at work."""
    whole = {x.rsplit("/", 1)[-1] for x in committed(spark, path)}
    gone = [x for x in _names(spark, path) if x.startswith("run=") and x not in whole]
    for name in gone:
        fs, at = _files(spark, f"{path}/{name}")
        fs.delete(at, True)
    return gone


def write_rejects(rows: DataFrame, path: str, reason: str = "reason") -> None:
    rows.where(F.col(reason).isNotNull()).write.mode("append").json(path)


def write_artefact(spark, value: dict, path: str) -> None:
    """A fitted model or summary as one JSON document."""
    import json

    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_scores(rows: DataFrame, path: str, text: str = "text") -> None:
    """CSV of scores, never of texts."""
    rows.drop(text).write.mode("overwrite").csv(path, header=True)
