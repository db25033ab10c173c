"""Co-change mining: pairs of files that commits change together, and traces that confirm relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least common commits, least score, and most files of a commit that counts.
MIN_COUNT, MIN_SCORE, MAX_FILES = 3, 0.3, 25


def co_changes(
    commits: DataFrame, *, min_count: int = MIN_COUNT, min_score: float = MIN_SCORE, max_files: int = MAX_FILES, included: DataFrame | None = None
) -> DataFrame:
    """``(source, target, co_changes, score)``, both directions, from ``commits`` (commit, path).

    Commits of more than ``max_files`` different files are noise; ``included``
    (path) restricts files after that. The score is the pair's count over the
    larger of the files' counts. A commit's files are gathered into one sorted
    array, bounded by ``max_files``, and paired by two explodes: no self-join,
    and a frequent file is never one task's key before the pairs are counted.
    """
    files = commits.select("commit", "path").distinct()
    baskets = files.groupBy("commit").agg(F.slice(F.sort_array(F.collect_set("path")), 1, max_files + 1).alias("files"))
    baskets = baskets.where(F.size("files") <= max_files).select("commit", F.explode("files").alias("path"))
    if included is not None:
        baskets = baskets.join(included.select("path").distinct(), "path", "left_semi")
    kept = baskets.groupBy("commit").agg(F.sort_array(F.collect_list("path")).alias("files"))
    freq = kept.select(F.explode("files").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    first = kept.select("files", F.posexplode("files").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    fa, fb = (freq.select(F.col("path").alias(c), F.col("n").alias(f"n{c}")) for c in ("a", "b"))
    scored = (
        counted.join(fa, "a").join(fb, "b").withColumn("score", F.col("n") / F.greatest("na", "nb")).where(F.col("score") >= min_score)
    )
    one, other = (
        scored.select(F.col(x).alias("source"), F.col(y).alias("target"), F.col("n").alias("co_changes"), "score")
        for x, y in (("a", "b"), ("b", "a"))
    )
    return one.unionByName(other)


def co_change_relations(pairs: DataFrame) -> DataFrame:
    """Heuristic CO_CHANGES relations with provenance ``co-change:<count>:<score, 2 digits>``."""
    return pairs.select(
        F.col("source").alias("source_entity_id"),
        F.col("target").alias("target_entity_id"),
        F.lit("CO_CHANGES").alias("kind"),
        F.lit("heuristic").alias("confidence"),
        F.format_string("co-change:%d:%.2f", F.col("co_changes"), F.col("score")).alias("provenance"),
    )


def partners(pairs: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """The strongest partners of one file: score and count down, then name."""
    return pairs.where(F.col("source") == path).orderBy(F.desc("score"), F.desc("co_changes"), "target").limit(min(max(limit, 1), 200))


def strongest_partner(pairs: DataFrame) -> DataFrame:
    """For each target, the source that couples most strongly with it."""
    order = F.struct(F.col("score"), F.col("co_changes"), F.col("source"))
    return pairs.groupBy("target").agg(F.max(order).alias("b")).select(
        "target", F.col("b.source").alias("source"), F.col("b.co_changes").alias("co_changes"), F.col("b.score").alias("score")
    )


def promote(relations: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations whose observed ones are proven now, and one row of counts (promoted, already_proven, unmatched).

    ``observed`` (source, target) may repeat edges. Confidence never falls.
    """
    seen = observed.select(F.col("source").alias("s"), F.col("target").alias("t")).distinct()
    hit = relations.join(
        seen, (relations["source_entity_id"] == seen["s"]) & (relations["target_entity_id"] == seen["t"]), "left"
    )
    raised = hit.withColumn("confidence", F.when(F.col("s").isNotNull(), F.lit("proven")).otherwise(F.col("confidence"))).drop("s", "t")
    ends = relations.groupBy(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t")).agg(
        F.count_if(F.col("confidence") != "proven").alias("open"), F.count_if(F.col("confidence") == "proven").alias("done")
    )
    counts = seen.join(ends, ["s", "t"], "left").agg(
        F.coalesce(F.sum("open"), F.lit(0)).alias("promoted"),
        F.coalesce(F.sum("done"), F.lit(0)).alias("already_proven"),
        F.count_if(F.col("open").isNull()).alias("unmatched"),
    )
    return raised, counts
