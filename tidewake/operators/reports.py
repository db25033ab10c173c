"""Impact reports: what a set of changed paths affects, how stale the index is, lanes, and deltas between reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.confidence import LEVELS, rank
from tidewake.functions.text import entity_kind
from tidewake.operators.traverse import impact_rows
from tidewake.session import if_small, stored

#: Weights of affected paths, actions and evidence, and the load at which a report is wider or narrower.
POLICIES = {
    "default": (3, 5, 1, 1, 1),
    "strict": (4, 7, 1, 6, 6),
    "relaxed": (2, 3, 1, 24, 12),
    "action-heavy": (2, 8, 1, 10, 8),
}
LANES = ("code", "tests", "knowledge", "crossRepo", "contracts", "config")
#: Reason and confidence of a changed path that no index run has seen.
NOT_INDEXED = "changed file not in index"


def stale_warnings(changed: DataFrame, indexed: DataFrame, live: DataFrame) -> DataFrame:
    """``(path, warning)`` of changed paths (path) against the index and the working tree (path, content_hash).

    ``coverage gap``: not indexed; ``unreadable``: indexed, but gone from the
    tree; ``stale``: the contents differ. Paths without a warning give no row;
    a null hash in the tree counts as unreadable. An empty ``changed`` gives none.
    """
    old = indexed.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("known"))
    rows = changed.select("path").distinct().join(old, "path", "left").join(live.select("path", F.col("content_hash").alias("new")), "path", "left")
    warning = F.when(F.col("known").isNull(), "coverage gap").when(F.col("new").isNull(), "unreadable").when(~F.col("old").eqNullSafe(F.col("new")), "stale")
    return rows.select("path", warning.alias("warning")).where("warning IS NOT NULL")


def snapshot_warnings(runs: DataFrame, now: DataFrame) -> DataFrame:
    """``(run, warning)`` of index runs against the repository now (repo, commit_sha, is_dirty).

    ``runs`` (run, repo, commit_sha, is_dirty). Runs without a commit have no
    snapshot and give no row; a dirty tree is only news if the run was clean.
    """
    tree = now.select("repo", F.col("commit_sha").alias("head"), F.col("is_dirty").alias("dirty_now"))
    rows = runs.where("commit_sha IS NOT NULL").join(tree, "repo", "left")
    found = F.array_compact(
        F.array(
            F.when(F.col("head") != F.col("commit_sha"), "head moved"),
            F.when(~F.col("is_dirty") & F.col("dirty_now"), "tree is dirty"),
            F.when(F.col("is_dirty"), "run was dirty"),
        )
    )
    return rows.select("run", F.explode(found).alias("warning"))


def impact_report(
    entities: DataFrame, relations: DataFrame, changed: DataFrame, fallback: DataFrame | None = None, cross: DataFrame | None = None,
    max_depth: int | None = None, max_fanout: int | None = None,
) -> DataFrame:
    """``(path, depth, confidence, reason)``: one row per affected path, whatever number of ``changed`` (path) reach it.

    The least depth wins, then the highest confidence. A path that isn't an
    entity's is itself reported, unknown and at depth 0. One that is, but that
    nothing points to, takes its rows from ``fallback`` (source_path,
    target_path, kind, confidence). ``cross`` (path, confidence, reason) are
    consumers in other repositories, at depth 1.
    """
    asked = stored(changed.select("path").distinct())
    seeds = stored(asked.join(entities.select("path", F.col("id").alias("seed")), "path", "left"))
    rows = impact_rows(entities, relations, seeds.where("seed IS NOT NULL"), max_depth, max_fanout)
    one = lambda depth, confidence, reason: [F.lit(depth).cast("int").alias("depth"), confidence.alias("confidence"), reason.alias("reason")]
    out = rows.select("path", F.col("depth").cast("int").alias("depth"), "confidence", F.col("kind").alias("reason"))
    gaps = seeds.where("seed IS NULL").select("path", *one(0, F.lit("unknown"), F.lit(NOT_INDEXED)))
    out = out.unionByName(gaps)
    if fallback is not None:
        met = rows.select("seed").distinct()
        alone = seeds.where("seed IS NOT NULL").join(met, "seed", "left_anti").select(F.col("path").alias("target_path"))
        out = out.unionByName(fallback.join(alone, "target_path", "left_semi").select(F.col("source_path").alias("path"), *one(1, F.col("confidence"), F.col("kind"))))
    if cross is not None:
        out = out.unionByName(cross.select("path", *one(1, F.col("confidence"), F.col("reason"))))
    best = F.min(F.struct("depth", (-rank(F.col("confidence"))).alias("r"), "reason", "confidence")).alias("b")
    return out.groupBy("path").agg(best).select("path", "b.depth", "b.confidence", "b.reason")


def evidence_counts(report: DataFrame, evidence: DataFrame) -> DataFrame:
    """``report`` with ``n_evidence``, the evidence rows whose file is the path."""
    counted = evidence.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_evidence"))
    return report.join(counted, "path", "left").na.fill(0, ["n_evidence"])


def ui_order(report: DataFrame, actions: DataFrame) -> DataFrame:
    """``report`` with ``actionable`` and its place in the list: actionable first, then confidence, depth and path."""
    marked = report.join(actions.select("path").distinct().withColumn("actionable", F.lit(True)), "path", "left").na.fill(False, ["actionable"])
    return marked.orderBy(F.col("actionable").desc(), rank(F.col("confidence")).desc(), "depth", "path")


def lane(path: Column, reason: Column, actionable: Column) -> Column:
    """The lane of an affected path: by its reason if that names another repository, else by what the file is."""
    why, kind = F.lower(reason), entity_kind(path)
    return (
        F.when(why.rlike(r"\bcross-repo\b|breaks_compatibility_with"), "crossRepo")
        .when(actionable | (kind == "test"), "tests")
        .when(kind.isin("decision", "proposal", "prd", "requirement", "policy", "doc") | why.rlike(r"\b(governs|documents|requires|proposes)\b"), "knowledge")
        .when((kind == "contract") | why.rlike(r"\b(contract|endpoint|asyncapi|openapi|graphql|protobuf)\b"), "contracts")
        .when(kind.isin("config", "workflow", "resource") | why.rlike(r"\b(configures|workflow|infra)\b"), "config")
        .otherwise("code")
    )


def lanes(report: DataFrame, actions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``(lane, n, top_path)`` of all six lanes; ``artifacts`` (path) that the knowledge lane doesn't have are added to its count.

    The top path is that of the highest confidence, then the least depth; null
    in an empty lane.
    """
    marked = report.join(actions.select("path").distinct().withColumn("a", F.lit(True)), "path", "left")
    rows = marked.withColumn("lane", lane(F.col("path"), F.col("reason"), F.coalesce("a", F.lit(False))))
    top = F.min(F.struct((-rank(F.col("confidence"))).alias("r"), "depth", "path"))["path"].alias("top_path")
    counted = rows.groupBy("lane").agg(F.count("*").alias("n"), top)
    extra = artifacts.select("path").distinct().join(rows.where("lane = 'knowledge'").select("path"), "path", "left_anti").agg(F.count("*").alias("extra")).withColumn("lane", F.lit("knowledge"))
    names = report.sparkSession.createDataFrame([(x,) for x in LANES], "lane string")
    whole = names.join(counted, "lane", "left").join(extra, "lane", "left").na.fill(0, ["n", "extra"])
    return whole.select("lane", (F.col("n") + F.col("extra")).alias("n"), "top_path")


def previous_reports(reports: DataFrame) -> DataFrame:
    """``reports`` (id, repo, created_at) with ``base``, the report of the same repository just before by (created_at, id)."""
    return reports.withColumn("base", F.lag("id").over(Window.partitionBy("repo").orderBy("created_at", "id")))


def report_deltas(reports: DataFrame, affected: DataFrame, policy: str = "default") -> DataFrame:
    """What changed against the report before, a row for each report (id, repo, created_at, n_actions, n_evidence) that has one.

    ``affected`` (id, path, confidence) has a path once per report. Gives the
    review load's change and whether that is wider, narrower or unchanged by
    ``policy``, the changes of the counts, added and removed paths, and the
    change of each confidence level.
    """
    w_affected, w_actions, w_evidence, widen, narrow = POLICIES[policy]
    levels = [F.count_if(F.col("confidence") == c).alias(c) for c in LEVELS]
    counted = affected.groupBy("id").agg(F.count("*").alias("n_affected"), *levels)
    counts = ("n_affected", *LEVELS)
    whole = stored(previous_reports(reports).join(counted, "id", "left").na.fill(0, list(counts)))
    kept = ("n_actions", "n_evidence", *counts)
    old = whole.select(F.col("id").alias("base"), *[F.col(c).alias(f"old_{c}") for c in kept])
    rows = whole.where("base IS NOT NULL").join(old, "base")
    pairs = if_small(whole.where("base IS NOT NULL").select("id", "base"))
    now = affected.join(pairs.select("id"), "id", "left_semi").select("id", "path", F.lit(1).alias("now"))
    then = affected.select(F.col("id").alias("base"), "path").join(pairs, "base").select("id", "path", F.lit(1).alias("then"))
    moved = now.join(then, ["id", "path"], "full_outer").groupBy("id").agg(F.count_if(F.col("then").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"))
    change = lambda c: F.col(c) - F.col(f"old_{c}")
    load = change("n_affected") * w_affected + change("n_actions") * w_actions + change("n_evidence") * w_evidence
    verdict = F.when(F.col("load") >= widen, "wider").when(F.col("load") <= -narrow, "narrower").otherwise("unchanged")
    return rows.join(moved, "id", "left").na.fill(0, ["added", "removed"]).withColumn("load", load).select(
        "id", "base", "load", verdict.alias("summary"), "added", "removed", *[change(c).alias(f"{c}_delta") for c in kept]
    )
