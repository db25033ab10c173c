"""Session helpers: where intermediate tables go, and what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it is hinted for broadcast, after counting.
SMALL_ROWS = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/tidewake/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table, hinted for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df
