"""Incremental indexing: what changed between two snapshots, and what is carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, change)`` of files (path, content_hash): added, deleted, changed or unchanged."""
    a = before.select("path", F.col("content_hash").alias("old"))
    b = after.select("path", F.col("content_hash").alias("new"))
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def index_mode(delta: DataFrame, before_version: str | None, version: str) -> DataFrame:
    """One row ``(mode, reason, n_changed, n_unchanged)``; incremental only if the version and the set of paths stayed."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    counted = delta.agg(n("added").alias("a"), n("deleted").alias("d"), n("changed").alias("n_changed"), n("unchanged").alias("n_unchanged"))
    reason = (
        F.when(F.lit(before_version is None), "no prior run")
        .when(F.lit(before_version != version), "extractor changed")
        .when(F.col("a") > 0, "files added")
        .when(F.col("d") > 0, "files deleted")
    )
    return counted.select(F.when(reason.isNull(), "incremental").otherwise("full").alias("mode"), reason.alias("reason"), "n_changed", "n_unchanged")


def carry_forward(before: DataFrame, delta: DataFrame, fresh: DataFrame, run: int, path: str = "path") -> DataFrame:
    """Rows of the new run: those of unchanged files, stamped anew, and the freshly extracted ones."""
    kept = before.join(delta.where("change = 'unchanged'").select(F.col("path").alias(path)), path, "left_semi")
    return kept.unionByName(fresh).withColumn("index_run_id", F.lit(run))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], first_wins: bool = False) -> DataFrame:
    """``table`` and ``new`` with one row per key: the new one, or the old one with ``first_wins``. ``new`` has a key once."""
    if first_wins:
        return table.unionByName(new.join(table.select(*keys), keys, "left_anti"))
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)
