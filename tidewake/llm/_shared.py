"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rows, as measured, up to which a table is broadcast.
BROADCAST_BYTES = 24 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the engine's byte-wise path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER)
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session, whose
    executors live on the driver's machine, gets a folder of its own when that
    is unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='tidewake-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str = "tidewake") -> str:
    """A folder of this application in the shared one; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}/{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: a lost executor costs no more than the tasks that it
    ran, and later reads neither recompute the rows nor see other ones.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(c: Column, kind: DataType) -> Column:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 8
    if isinstance(kind, StructType):
        return sum((_bytes(c.getField(f.name), f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, ArrayType):
        one = F.aggregate(c, F.lit(16).cast("long"), lambda sum, x: sum + _bytes(x, kind.elementType))
        return F.coalesce(one, F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table), hinted for broadcast if its rows take ``BROADCAST_BYTES`` at most.

    Beyond that there is no hint: the join shuffles, and adaptive execution
    splits the hot keys of the other side.
    """
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df
