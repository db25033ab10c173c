"""Confidence levels of relations and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, from the lowest to the highest.
LEVELS = ("unknown", "heuristic", "inferred", "proven")


def coerce(value: Column) -> Column:
    """The level, or ``unknown`` for anything that isn't one."""
    return F.when(value.isin(*LEVELS), value).otherwise("unknown")


def rank(value: Column) -> Column:
    """3 for proven down to 0 for unknown and invalid levels."""
    out = F.lit(0)
    for n, level in enumerate(LEVELS):
        out = F.when(value == level, n).otherwise(out)
    return out


def gate(affected: DataFrame, level: str, column: str = "confidence") -> DataFrame:
    """One row ``(failed)``: whether any row is at or over ``level``; ``any`` takes every row and ``none`` no row."""
    if level not in (*LEVELS, "any", "none"):
        raise ValueError(f"unknown gate level: {level}")
    if level == "none":
        return affected.agg(F.lit(False).alias("failed"))
    least = 0 if level == "any" else LEVELS.index(level)
    return affected.agg((F.coalesce(F.max(rank(F.col(column))), F.lit(-1)) >= least).alias("failed"))


RANK_SQL = "CASE confidence WHEN 'proven' THEN 3 WHEN 'inferred' THEN 2 WHEN 'heuristic' THEN 1 ELSE 0 END"
