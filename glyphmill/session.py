"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a new one where it is unset and all run on one machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_glyphmill_shared", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = sc._glyphmill_shared = f"file://{tempfile.mkdtemp(prefix='glyphmill-')}"
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once; on a cluster they can't import it otherwise."""
    sc = spark.sparkContext
    if getattr(sc, "_glyphmill_shipped", False):
        return
    root = Path(__file__).parent
    out = Path(tempfile.mkdtemp(prefix="glyphmill-")) / "glyphmill.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"glyphmill/{p.relative_to(root)}")
    sc.addPyFile(str(out))
    sc._glyphmill_shipped = True


def stored(df, *by: str):
    """df written to the shared folder, partitioned by the columns of by, and read again: computed once, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
