"""Queries of health and telemetry over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import exports
from tidewake.operators.delta import upsert
from tidewake.plans.graph_views import relations, table
from tidewake.sources.scan import session_facts


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, long ones, and those with a label."""
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return docs.join(labelled, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("n_long"), F.count("known").alias("n_labelled"), F.countDistinct("source").alias("n_sources")
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of runs and accesses in one row: two aggregates of one row each, side by side."""
    runs = table(spark, sf_dir, "events").agg(F.count("*").alias("runs"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("value"))
    reads = table(spark, sf_dir, "conversations").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).alias("bytes"))
    return runs.crossJoin(reads)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, of which some come anew with another balance."""
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    new = old.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 1).alias("s_suppkey"), F.lit(0.0).alias("s_acctbal"))
    return upsert(old, new, ["s_suppkey"])


def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns name the document of the same number, if there is one."""
    known = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    named = F.concat_ws(" ", "text", F.concat(F.lit("doc/"), F.col("conv_id").cast("string"), F.lit(".md")))
    return session_facts(table(spark, sf_dir, "conversations").withColumn("text", named), known)


def graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as one DOT text."""
    return exports.dot(relations(spark, sf_dir, ("PART_OF",)))


QUERIES = {f.__name__: f for f in (coverage, telemetry, upsert_latest, session_summaries, graph_dot)}
ORACLES = {
    "coverage": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS n_long, count(k.doc_id) AS n_labelled, count(DISTINCT source) AS n_sources "
    "FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) k USING (doc_id) GROUP BY lang",
    "telemetry": "SELECT * FROM (SELECT count(*) AS runs, count(DISTINCT user_id) AS users, round(sum(value), 2) AS value FROM events), "
    "(SELECT count(*) AS turns, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM conversations)",
    "upsert_latest": "WITH n AS (SELECT s_suppkey + 1 AS s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n) "
    "UNION ALL SELECT s_suppkey, 0.0 FROM n",
    "session_summaries": "SELECT conv_id, 'summary' AS kind, CAST(count(*) AS VARCHAR) || ' messages, ' || CAST(count(*) FILTER (WHERE role = 'tool') AS VARCHAR) || ' tool calls' AS value FROM conversations GROUP BY conv_id "
    "UNION ALL SELECT DISTINCT conv_id, 'file', 'doc/' || CAST(doc_id AS VARCHAR) || '.md' FROM conversations JOIN documents ON doc_id = conv_id",
    "graph_dot": "SELECT 'digraph impact {' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) || '}' AS text FROM (SELECT '  \"nation:' || CAST(n_nationkey AS VARCHAR) || '\" -> \"region:' || "
    "CAST(n_regionkey AS VARCHAR) || '\" [label=\"PART_OF\"];' AS l FROM nation)",
}
