"""Versioned snapshots: a run's tables are written to a folder of their own and count once its manifest is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_runs"


def _path(root: str, run: int, table: str) -> str:
    return f"{root.rstrip('/')}/{table}/run={run}"


def write_run(spark: SparkSession, root: str, run: int, tables: dict[str, DataFrame], **info: str) -> None:
    """Writes all tables of a run, then its manifest, which commits it.

    A run that fails before leaves folders that no reader sees; earlier runs
    are never touched, so nothing has to be rolled back. A run number is used
    once, by one writer: two that write the same number at a time aren't told apart.
    """
    if not runs(spark, root).where(F.col("run") == run).isEmpty():
        raise ValueError(f"run {run} is already committed")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(_path(root, run, name))
    row = [(run, ",".join(sorted(tables)), *map(str, info.values()))]
    columns = ["run long", "tables string", *(f"{k} string" for k in info)]
    spark.createDataFrame(row, ", ".join(columns)).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/{MANIFESTS}")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Committed runs: ``(run, tables)``."""
    schema = "run long, tables string"
    path = f"{root.rstrip('/')}/{MANIFESTS}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def read_run(spark: SparkSession, root: str, table: str, run: int | None = None) -> DataFrame:
    """A table of a committed run, the latest by default, with ``index_run_id``. Other runs' files are not listed."""
    known = runs(spark, root).where(F.array_contains(F.split("tables", ","), table))
    chosen = (known if run is None else known.where(F.col("run") == run)).agg(F.max("run")).first()[0]
    if chosen is None:
        raise ValueError(f"no committed run of {table}" if run is None else f"run {run} isn't committed")
    return spark.read.parquet(_path(root, chosen, table)).withColumn("index_run_id", F.lit(chosen).cast("long"))
