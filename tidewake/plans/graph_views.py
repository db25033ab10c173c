"""Property-graph views over relational tables: entities, relations and evidence.

Ids are ``kind:key`` and paths ``kind/key``. A relation's id is a content hash
of its kind, ends and provenance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table, key column, name column of each entity kind.
ENTITY_TABLES = (
    ("region", "r_regionkey", "r_name"),
    ("nation", "n_nationkey", "n_name"),
    ("customer", "c_custkey", "c_name"),
    ("supplier", "s_suppkey", "s_name"),
    ("part", "p_partkey", "p_name"),
    ("orders", "o_orderkey", "o_orderstatus"),
)
#: Relation kind, source kind and key, target kind and key, table, SQL of confidence and provenance.
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'proven' WHEN 'O' THEN 'inferred' ELSE 'heuristic' END"
_FLAG = "CASE l_returnflag WHEN 'A' THEN 'proven' WHEN 'N' THEN 'inferred' ELSE 'heuristic' END"
_LINE = "concat('line:', CAST(l_linenumber AS STRING))"
RELATION_TABLES = (
    ("PLACED_BY", "orders", "o_orderkey", "customer", "o_custkey", "orders", _STATUS, "'order'"),
    ("CONTAINS", "orders", "l_orderkey", "part", "l_partkey", "lineitem", _FLAG, _LINE),
    ("SUPPLIED_BY", "orders", "l_orderkey", "supplier", "l_suppkey", "lineitem", _FLAG, _LINE),
    ("LOCATED_IN", "customer", "c_custkey", "nation", "c_nationkey", "customer", "'proven'", "'address'"),
    ("LOCATED_IN", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier", "'proven'", "'address'"),
    ("PART_OF", "nation", "n_nationkey", "region", "n_regionkey", "nation", "'proven'", "'map'"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, kind, path, display_name, symbol, language_id)``."""
    out = None
    for name, key, label in ENTITY_TABLES:
        some = table(spark, sf_dir, name).select(
            node_id(name, key).alias("id"),
            F.lit(name).alias("kind"),
            F.concat(F.lit(f"{name}/"), F.col(key).cast("string")).alias("path"),
            F.col(label).alias("display_name"),
            F.lit(None).cast("string").alias("symbol"),
            F.lit(None).cast("string").alias("language_id"),
        )
        out = some if out is None else out.unionByName(some)
    return out


def relation_id(kind: Column, source: Column, target: Column, provenance: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", kind, source, target, provenance)), 1, 20)


def relations(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``(id, source_entity_id, target_entity_id, kind, confidence, provenance)``, of some kinds only if given.

    The kind is a literal of each branch, so a filter on it prunes whole tables.
    """
    out = None
    for kind, source, source_key, target, target_key, name, confidence, provenance in RELATION_TABLES:
        if kinds and kind not in kinds:
            continue
        some = table(spark, sf_dir, name).select(
            node_id(source, source_key).alias("source_entity_id"),
            node_id(target, target_key).alias("target_entity_id"),
            F.lit(kind).alias("kind"),
            F.expr(confidence).alias("confidence"),
            F.expr(provenance).alias("provenance"),
        )
        out = some if out is None else out.unionByName(some)
    own = [F.col(c) for c in ("kind", "source_entity_id", "target_entity_id", "provenance")]
    return out.select(relation_id(*own).alias("id"), *out.columns)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, relation_id, file_path, kind, snippet, confidence, start_line)``: the line items behind CONTAINS relations."""
    own = [F.lit("CONTAINS"), node_id("orders", "l_orderkey"), node_id("part", "l_partkey"), F.expr(_LINE)]
    rel = relation_id(*own)
    snippet = F.concat_ws(" ", F.lit("ship"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_returnflag"), F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(
        F.substring(F.sha1(F.concat_ws(":", rel, snippet)), 1, 20).alias("id"),
        rel.alias("relation_id"),
        F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("file_path"),
        F.lit("lineitem").alias("kind"),
        snippet.alias("snippet"),
        F.expr(_FLAG).alias("confidence"),
        F.col("l_linenumber").cast("int").alias("start_line"),
    )


# --- the same views for the SQL check ---------------------------------------


def _varchar(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


ENTITIES_SQL = "entities AS (" + " UNION ALL ".join(
    f"SELECT '{name}:' || CAST({key} AS VARCHAR) AS id, '{name}' AS kind, '{name}/' || CAST({key} AS VARCHAR) AS path, "
    f"{label} AS display_name FROM {name}"
    for name, key, label in ENTITY_TABLES
) + ")"
RELATIONS_SQL = "relations AS (SELECT left(sha1(kind || ':' || source_entity_id || ':' || target_entity_id || ':' || provenance), 20) AS id, * FROM (" + " UNION ALL ".join(
    f"SELECT '{source}:' || CAST({skey} AS VARCHAR) AS source_entity_id, '{target}:' || CAST({tkey} AS VARCHAR) AS target_entity_id, "
    f"'{kind}' AS kind, {confidence} AS confidence, {_varchar(provenance)} AS provenance FROM {name}"
    for kind, source, skey, target, tkey, name, confidence, provenance in RELATION_TABLES
) + "))"
