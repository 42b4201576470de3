"""Analysis of a stream of documents: style features and reports stay inside a row, so they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import EngineConfig
from ..operators import style
from ..plans.report import report


def stream_reports(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """The report of each arriving document; append mode, no watermark needed."""
    return report(docs, id_col, text_col, config)


def windowed_audit(docs: DataFrame, time_col: str, group_col: str, window: str = "1 hour", late: str = "10 minutes", text_col: str = "text", config: EngineConfig = EngineConfig()) -> DataFrame:
    """(window, group, n, flagged, mean_p) of the style score per event-time window; rows later than `late` are dropped with their window's state."""
    rows = docs.withColumn("__id", F.struct(F.col(time_col).alias("at"), F.col(group_col).alias("group")))
    scored = style.features(style.prepare(rows, "__id", text_col, config), config).select(F.col("__id.at").alias("at"), F.col("__id.group").alias("group"), "style")
    return scored.withWatermark("at", late).groupBy(F.window("at", window), "group").agg(F.count("*").alias("n"), F.sum((F.col("style") >= config.level_high).cast("int")).alias("flagged"), F.avg("style").alias("mean_p"))
