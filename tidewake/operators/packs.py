"""Context packs and work artifacts: what of an impact result is shown, in which order, within which limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.confidence import rank
from tidewake.functions.text import snippet

#: Limits of a pack by size (depth, fanout, affected files, artifacts, evidence rows, snippet characters, co-changes).
PACKS = {
    "brief": (1, 50, 5, 5, 5, 300, 3),
    "standard": (2, 200, 15, 12, 12, 800, 5),
    "deep": (3, 500, 50, 30, 30, 1500, 10),
}
#: Days after which a work artifact of a kind is stale, and of any other kind.
STALE_DAYS, STALE_DEFAULT = {"proposal": 60, "prd": 120, "requirement": 120, "decision": 180}, 90


#: Patterns of paths in order of their priority in a pack; all others come last.
PACK_PATHS = (r"(^|/)(tests?|__tests__)/|(\.|-)(test|spec)\.", r"\.md$|^docs/", r"^\.github/workflows/|\.(ya?ml|json|toml)$")


def path_priority(path: Column) -> Column:
    """0 for tests, 1 for documents, 2 for configuration, 3 for the rest."""
    out = F.lit(len(PACK_PATHS))
    for n in reversed(range(len(PACK_PATHS))):
        out = F.when(path.rlike(PACK_PATHS[n]), n).otherwise(out)
    return out


def pack_order() -> list[Column]:
    """Depth, confidence down, priority of the path, path."""
    return [F.col("depth"), rank(F.col("confidence")).desc(), path_priority(F.col("path")), F.col("path")]


def context_pack(affected: DataFrame, size: str = "standard") -> DataFrame:
    """``(path, depth, confidence, place, omitted)``: the first affected files of a pack, and how many are left out."""
    most = PACKS[size][2]
    total = affected.agg(F.count("*").alias("all"))
    top = affected.orderBy(*pack_order()).limit(most)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*pack_order())))
    return placed.crossJoin(total).select("path", "depth", "confidence", "place", F.greatest(F.col("all") - most, F.lit(0)).alias("omitted"))


def evidence_of(affected: DataFrame, evidence: DataFrame, size: str = "standard") -> DataFrame:
    """Evidence (path, kind, text, confidence, start_line) of affected paths, best first, texts cut, within the pack's limit."""
    _, _, _, _, most, chars, _ = PACKS[size]
    kept = evidence.join(affected.select("path").distinct(), "path", "left_semi")
    order = [rank(F.col("confidence")).desc(), F.col("start_line").isNull(), F.char_length("text"), F.col("path"), F.col("kind"), F.col("text")]
    return kept.orderBy(*order).limit(most).withColumn("text", snippet(F.col("text"), chars))


def freshness(artifacts: DataFrame, today: Column) -> DataFrame:
    """``artifacts`` (path, kind, updated_at) with ``age_days`` and ``freshness``: current, stale, or unknown for a date that is none."""
    days = F.create_map(*[F.lit(x) for kv in STALE_DAYS.items() for x in kv])
    age = F.greatest(F.lit(0), F.datediff(today, F.try_to_date("updated_at", "yyyy-MM-dd")))
    limit = F.coalesce(F.element_at(days, F.col("kind")), F.lit(STALE_DEFAULT))
    known = F.try_to_date("updated_at", "yyyy-MM-dd").isNotNull()
    state = F.when(~known, "unknown").when(age > limit, "stale").otherwise("current")
    return artifacts.withColumn("age_days", F.when(known, age)).withColumn("freshness", state)


def one_per_artifact(artifacts: DataFrame) -> DataFrame:
    """One row per kind and path, at its least depth."""
    return artifacts.groupBy("kind", "path").agg(F.min("depth").alias("depth"), F.min_by("updated_at", "depth").alias("updated_at"))
