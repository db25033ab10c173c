"""Queries of impact reports, and their SQL. A set of changed paths stands in for a commit, an order for a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.confidence import RANK_SQL
from tidewake.operators import exports, reports
from tidewake.plans.graph_views import entities, evidence, relations, table
from tidewake.plans.graph_queries import EDGES, GRAPH_SQL
from tidewake.session import stored


def _key(prefix: str, column: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), column.cast("string"), F.lit(suffix))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, one that isn't there, and urgent orders, which nothing points to."""
    nations = table(spark, sf_dir, "nation").select(F.explode(F.array(_key("nation/", F.col("n_nationkey")), _key("nation/", F.col("n_nationkey") + 1))).alias("path"))
    return nations.unionByName(table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(_key("orders/", F.col("o_orderkey")).alias("path")))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, stored, as what reads it reads it more than once."""
    legacy = table(spark, sf_dir, "orders").select(
        _key("customer/", F.col("o_custkey")).alias("source_path"), _key("orders/", F.col("o_orderkey")).alias("target_path"), F.lit("PLACED").alias("kind"), F.lit("heuristic").alias("confidence")
    )
    return stored(reports.impact_report(entities(spark, sf_dir), relations(spark, sf_dir), _changed(spark, sf_dir), legacy, max_depth=2))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(_key("orders/", F.col("o_orderkey")).alias("path"))


def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected path with the evidence rows in it."""
    rows = reports.evidence_counts(_report(spark, sf_dir), evidence(spark, sf_dir))
    return rows.withColumn("depth", F.col("depth").cast("long"))


def impact_report_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty paths of the report's list."""
    return reports.ui_order(_report(spark, sf_dir), _actions(spark, sf_dir)).limit(50).withColumn("depth", F.col("depth").cast("long"))


def impact_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report by lane, its paths taken for documents, contracts, manifests and code."""
    path = F.col("path")
    named = (
        F.when(path.startswith("customer/"), F.concat(F.lit("docs/"), path, F.lit(".md")))
        .when(path.startswith("supplier/"), F.concat(path, F.lit("/openapi.yaml")))
        .when(path.startswith("nation/"), F.concat(path, F.lit("/package.json")))
        .otherwise(F.concat(path, F.lit(".ts")))
    )
    rows = _report(spark, sf_dir).withColumn("path", named)
    actions = _actions(spark, sf_dir).withColumn("path", F.concat("path", F.lit(".ts")))
    artifacts = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(_key("docs/customer/", F.col("c_custkey"), ".md").alias("path"))
    return reports.lanes(rows, actions, artifacts).withColumn("label", exports.blast_label(F.col("n")))


def stale_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations against a tree that lacks those without suppliers, and in which those with a debtor have changed."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", _key("nation/", F.col("n_nationkey")).alias("path"), F.sha1("n_name").alias("content_hash"))
    least = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_acctbal").alias("least"))
    live = nations.join(least, "n_nationkey").select("path", F.when(F.col("least") < 0, F.sha1("path")).otherwise(F.col("content_hash")).alias("content_hash"))
    changed = _changed(spark, sf_dir).where("path LIKE 'nation/%'")
    return reports.stale_warnings(changed, nations, live)


def report_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order against the same customer's order before: parts affected, lines as evidence, returns as actions."""
    lines = table(spark, sf_dir, "lineitem")
    counted = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_evidence"), F.count_if(F.col("l_returnflag") == "R").alias("n_actions"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("created_at"))
    rows = orders.join(counted, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey").na.fill(0, ["n_evidence", "n_actions"])
    worst = F.expr("CASE max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) WHEN 3 THEN 'proven' WHEN 2 THEN 'inferred' ELSE 'heuristic' END")
    affected = lines.groupBy(F.col("l_orderkey").alias("id"), _key("part/", F.col("l_partkey")).alias("path")).agg(worst.alias("confidence"))
    return reports.report_deltas(rows, affected)


QUERIES = {f.__name__: f for f in (impact_report, impact_report_top, impact_lanes, stale_warnings, report_deltas)}

_CHANGED = (
    "changed AS (SELECT 'nation/' || CAST(n_nationkey AS VARCHAR) AS path FROM nation UNION SELECT 'nation/' || CAST(n_nationkey + 1 AS VARCHAR) FROM nation "
    "UNION SELECT 'orders/' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority LIKE '1%')"
)
_REPORT = f"""WITH RECURSIVE {GRAPH_SQL}, {EDGES}, {_CHANGED},
    seeds AS (SELECT path, id FROM changed LEFT JOIN entities USING (path)),
    walk(seed, node, depth) AS (SELECT id, id, 0 FROM seeds WHERE id IS NOT NULL UNION SELECT seed, source, depth + 1 FROM walk JOIN edges USING (node) WHERE depth < 1),
    hits AS (SELECT seed, path, depth + 1 AS depth, confidence, kind AS reason FROM walk JOIN edges USING (node)),
    alone AS (SELECT path FROM seeds WHERE id IS NOT NULL AND id NOT IN (SELECT seed FROM hits)),
    every AS (SELECT path, depth, confidence, reason FROM hits UNION ALL SELECT path, 0, 'unknown', 'changed file not in index' FROM seeds WHERE id IS NULL
        UNION ALL SELECT 'customer/' || CAST(o_custkey AS VARCHAR), 1, 'heuristic', 'PLACED' FROM orders JOIN alone ON path = 'orders/' || CAST(o_orderkey AS VARCHAR)),
    report AS (SELECT path, CAST(depth AS BIGINT) AS depth, confidence, reason FROM every
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY depth, {RANK_SQL} DESC, reason) = 1),
    actions AS (SELECT 'orders/' || CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderstatus = 'F') """

ORACLES = {
    "impact_report": _REPORT
    + ", e AS (SELECT 'orders/' || CAST(l_orderkey AS VARCHAR) AS path, count(*) AS n FROM lineitem GROUP BY 1) SELECT report.*, coalesce(n, 0) AS n_evidence FROM report LEFT JOIN e USING (path)",
    "impact_report_top": _REPORT + f"SELECT *, path IN (SELECT path FROM actions) AS actionable FROM report ORDER BY actionable DESC, {RANK_SQL} DESC, depth, path LIMIT 50",
    "impact_lanes": _REPORT
    + """, named AS (SELECT *, CASE WHEN path IN (SELECT path FROM actions) THEN 'tests' WHEN path LIKE 'customer/%' THEN 'knowledge' WHEN path LIKE 'supplier/%' THEN 'contracts'
        WHEN path LIKE 'nation/%' THEN 'config' ELSE 'code' END AS lane,
        CASE WHEN path LIKE 'customer/%' THEN 'docs/' || path || '.md' WHEN path LIKE 'supplier/%' THEN path || '/openapi.yaml' WHEN path LIKE 'nation/%' THEN path || '/package.json' ELSE path || '.ts' END AS name FROM report),
    top AS (SELECT lane, name FROM named QUALIFY row_number() OVER (PARTITION BY lane ORDER BY """
    + RANK_SQL
    + """ DESC, depth, name) = 1),
    extra AS (SELECT count(*) AS n FROM customer WHERE c_acctbal < 0 AND 'customer/' || CAST(c_custkey AS VARCHAR) NOT IN (SELECT path FROM report)),
    every_lane(lane) AS (VALUES ('code'), ('tests'), ('knowledge'), ('crossRepo'), ('contracts'), ('config'))
    SELECT *, CASE WHEN n = 0 THEN 'clear' WHEN n <= 3 THEN 'contained' WHEN n <= 12 THEN 'expanding' ELSE 'wide' END AS label FROM (SELECT lane, coalesce(c.n, 0) + CASE lane WHEN 'knowledge' THEN extra.n ELSE 0 END AS n, name AS top_path FROM every_lane LEFT JOIN (SELECT lane, count(*) AS n FROM named GROUP BY lane) c USING (lane) LEFT JOIN top USING (lane), extra)""",
    "stale_warnings": f"WITH {_CHANGED}, l AS (SELECT s_nationkey AS k, min(s_acctbal) AS least FROM supplier GROUP BY 1) SELECT path, CASE WHEN n_nationkey IS NULL THEN 'coverage gap' WHEN k IS NULL THEN 'unreadable' ELSE 'stale' END AS warning "
    "FROM changed LEFT JOIN nation ON path = 'nation/' || CAST(n_nationkey AS VARCHAR) LEFT JOIN l ON k = n_nationkey WHERE path LIKE 'nation/%' AND (n_nationkey IS NULL OR k IS NULL OR least < 0)",
    "report_deltas": """WITH a AS (SELECT l_orderkey AS id, l_partkey AS part, max(CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS r FROM lineitem GROUP BY 1, 2),
    c AS (SELECT id, count(*) AS n_affected, count(*) FILTER (WHERE r = 3) AS proven, count(*) FILTER (WHERE r = 2) AS inferred, count(*) FILTER (WHERE r = 1) AS heuristic FROM a GROUP BY id),
    l AS (SELECT l_orderkey AS id, count(*) AS n_evidence, count(*) FILTER (WHERE l_returnflag = 'R') AS n_actions FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS base FROM orders),
    w AS (SELECT o.id, base, coalesce(n_affected, 0) AS n_affected, coalesce(proven, 0) AS proven, coalesce(inferred, 0) AS inferred, coalesce(heuristic, 0) AS heuristic, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_actions, 0) AS n_actions
        FROM o LEFT JOIN c ON c.id = o.id LEFT JOIN l ON l.id = o.id),
    s AS (SELECT w.id, count(*) AS same FROM w JOIN a x ON x.id = w.id JOIN a y ON y.id = w.base AND x.part = y.part GROUP BY 1),
    d AS (SELECT n.id, n.base, 3 * (n.n_affected - p.n_affected) + 5 * (n.n_actions - p.n_actions) + n.n_evidence - p.n_evidence AS load, n.n_affected - coalesce(same, 0) AS added, p.n_affected - coalesce(same, 0) AS removed,
        n.n_actions - p.n_actions AS n_actions_delta, n.n_evidence - p.n_evidence AS n_evidence_delta, n.n_affected - p.n_affected AS n_affected_delta, CAST(0 AS BIGINT) AS unknown_delta,
        n.heuristic - p.heuristic AS heuristic_delta, n.inferred - p.inferred AS inferred_delta, n.proven - p.proven AS proven_delta
        FROM w n JOIN w p ON p.id = n.base LEFT JOIN s ON s.id = n.id)
    SELECT *, CASE WHEN load >= 1 THEN 'wider' WHEN load <= -1 THEN 'narrower' ELSE 'unchanged' END AS summary FROM d""",
}
