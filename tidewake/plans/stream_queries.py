"""Queries of entity search by stream, and of an index's scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import facts as store
from tidewake.operators import search as se
from tidewake.operators import streams as st
from tidewake.plans import fact_queries as fq
from tidewake.plans.graph_queries import GRAPH_SQL
from tidewake.plans.graph_views import entities, evidence, relations, table
from tidewake.plans.search_queries import ORACLES as SEARCH_SQL
from tidewake.plans.search_queries import retrieval_metrics


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's entities, and the users that facts are about."""
    name = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    none = [F.lit(None).cast("string").alias(c) for c in ("path", "symbol", "language_id")]
    users = table(spark, sf_dir, "events").select(name.alias("id")).distinct().select("id", F.lit("user").alias("kind"), F.col("id").alias("display_name"), *none)
    return entities(spark, sf_dir).unionByName(users)


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def entity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(st.entity_stream(_known(spark, sf_dir), "_1"), "rank")


def relation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(st.relation_stream(_known(spark, sf_dir), relations(spark, sf_dir), "line:1"), "rank")


def evidence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(st.evidence_stream(_known(spark, sf_dir), relations(spark, sf_dir), evidence(spark, sf_dir), "ship 1996"), "rank", "n")


def evidence_stream_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream without its index of terms."""
    return _long(st.evidence_stream(_known(spark, sf_dir), relations(spark, sf_dir), evidence(spark, sf_dir), "-12 R", terms=False), "rank", "n")


def fact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their purchases on the main branch."""
    v = fq.views(spark, sf_dir)
    scope = store.branch_scope(v["transactions"], "br_0")
    hidden = store.superseded(v["facts"], v["transactions"], v["provenance"], scope)
    seen = store.visible(v["facts"], v["transactions"], v["provenance"], scope)
    return _long(st.fact_stream(_known(spark, sf_dir), seen, hidden, "purchase"), "rank")


def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1500 of all streams fused; facts come after evidence in one list."""
    streams = {
        "entity": entity_stream(spark, sf_dir),
        "relation": relation_stream(spark, sf_dir),
        "evidence": st.after(evidence_stream(spark, sf_dir), fact_stream(spark, sf_dir)),
    }
    return _long(se.fuse(streams).where(F.col("rank") <= se.STREAM_ROWS * len(streams)), "rank")


def retrieval_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.mean_metrics(retrieval_metrics(spark, sf_dir))


def index_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' parts expected from lines of more than ten, and found from lines of less than forty."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("CONTAINS").alias("kind"), "l_quantity", "l_returnflag", "l_linenumber")
    key = ["source", "target", "kind"]
    expected = lines.where("l_quantity > 10").groupBy(*key).agg(F.max("l_returnflag").alias("adapter"))
    actual = lines.where("l_quantity < 40").groupBy(*key).agg(F.min("l_returnflag").alias("adapter"), F.count_if(F.col("l_quantity") > 5).alias("n_evidence"), F.count_if(F.col("l_linenumber") > 1).alias("n_spans"))
    scores = st.index_scores(expected, actual).withColumns({"affected_recall": F.lit(1.0), "pack_readiness": F.lit(1.0)})
    return st.weighted_score(scores)


QUERIES = {f.__name__: f for f in (entity_stream, relation_stream, evidence_stream, evidence_stream_like, fact_stream, entity_search, retrieval_means, index_scores)}

_KNOWN = f"{GRAPH_SQL}, known AS (SELECT id, kind, path, display_name FROM entities UNION ALL SELECT DISTINCT 'user:' || CAST(user_id AS VARCHAR), 'user', NULL, 'user:' || CAST(user_id AS VARCHAR) FROM events)"
_BOTH = "(SELECT source_entity_id AS entity, r.* FROM relations r UNION ALL SELECT target_entity_id, r.* FROM relations r WHERE source_entity_id <> target_entity_id)"
_ROWS = """proof AS (SELECT left(sha1('CONTAINS:orders:' || CAST(l_orderkey AS VARCHAR) || ':part:' || CAST(l_partkey AS VARCHAR) || ':line:' || CAST(l_linenumber AS VARCHAR)), 20) AS relation_id,
    lower('orders/' || CAST(l_orderkey AS VARCHAR) || ' lineitem ' || s) AS t, lower(s) AS s FROM (SELECT *, 'ship ' || strftime(l_shipdate, '%Y-%m-%d') || ' ' || l_returnflag || ' ' || l_linestatus AS s FROM lineitem))"""


def _top(rows: str) -> str:
    place = "row_number() OVER (ORDER BY n DESC, display_name, id)"
    return f"SELECT c.*, {place} AS rank FROM ({rows}) c JOIN known USING (id) QUALIFY {place} <= 500"


_ENTITY = """SELECT id, id_match, path_match, display_name_match, symbol_match, row_number() OVER (ORDER BY id_match DESC, path_match DESC, display_name_match DESC, symbol_match DESC, display_name, id) AS rank
    FROM (SELECT *, contains(lower(id), '_1') AS id_match, coalesce(contains(lower(path), '_1'), false) AS path_match, coalesce(contains(lower(display_name), '_1'), false) AS display_name_match, false AS symbol_match FROM known)
    WHERE id_match OR path_match OR display_name_match QUALIFY row_number() OVER (ORDER BY id_match DESC, path_match DESC, display_name_match DESC, symbol_match DESC, display_name, id) <= 500"""
_RELATION = _top(f"SELECT entity AS id, count(*) AS n, min(kind) AS bucket FROM {_BOTH} WHERE contains(lower(kind), 'line:1') OR contains(lower(provenance), 'line:1') GROUP BY entity")
_HITS = f"SELECT entity AS id, count(*) AS n, min(kind) AS bucket FROM {_BOTH} b JOIN proof ON relation_id = b.id WHERE "
_EVIDENCE = _top(_HITS + "len([x for x in regexp_extract_all(t, '[\\p{L}\\p{N}]+') if starts_with(x, 'ship')]) > 0 AND len([x for x in regexp_extract_all(t, '[\\p{L}\\p{N}]+') if starts_with(x, '1996')]) > 0 GROUP BY entity")
_MAIN = fq._scoped("SELECT id FROM transactions WHERE branch_id = 'br_0'")
_FACTS = f"{fq._VIEWS}, {_MAIN}"
_FACT = _top(
    "SELECT entity_id AS id, count(DISTINCT id) AS n FROM shown WHERE op = 'assert' AND id NOT IN (SELECT id FROM hidden) "
    "AND len([x for x in regexp_extract_all(lower(entity_id || ' ' || attribute || ' ' || value), '[\\p{L}\\p{N}]+') if starts_with(x, 'purchase')]) > 0 GROUP BY entity_id"
)
_SCORES = """e AS (SELECT l_orderkey AS s, l_partkey AS t, max(l_returnflag) AS want FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
    a AS (SELECT l_orderkey AS s, l_partkey AS t, min(l_returnflag) AS own, count(*) FILTER (WHERE l_quantity > 5) AS n, count(*) FILTER (WHERE l_linenumber > 1) AS m FROM lineitem WHERE l_quantity < 40 GROUP BY ALL),
    c AS (SELECT (SELECT count(*) FROM e) AS e, (SELECT count(*) FROM a) AS a, count(*) AS hit, count(*) FILTER (WHERE n > 0) AS proof, count(*) FILTER (WHERE m > 0) AS span, count(*) FILTER (WHERE own = want) AS own FROM e JOIN a USING (s, t)),
    r AS (SELECT round(hit / e, 6) AS relation_recall, round(hit / a, 6) AS relation_precision, round(proof / e, 6) AS evidence_presence, round(span / e, 6) AS span_completeness, round(own / e, 6) AS attribution,
        CAST(1 AS DOUBLE) AS affected_recall, CAST(1 AS DOUBLE) AS pack_readiness FROM c)"""

ORACLES = {
    "entity_stream": f"WITH {_KNOWN} {_ENTITY}",
    "relation_stream": f"WITH {_KNOWN} {_RELATION}",
    "evidence_stream": f"WITH {_KNOWN}, {_ROWS} {_EVIDENCE}",
    "evidence_stream_like": f"WITH {_KNOWN}, {_ROWS} " + _top(_HITS + "contains(s, '-12 r') GROUP BY entity"),
    "fact_stream": f"WITH {_KNOWN}, {_FACTS} {_FACT}",
    "entity_search": f"WITH {_KNOWN}, {_ROWS}, {_FACTS}, s1 AS ({_ENTITY}), s2 AS ({_RELATION}), s3 AS ({_EVIDENCE}), s4 AS ({_FACT}), "
    "ef AS (SELECT id, min(x) AS x FROM (SELECT id, rank AS x FROM s3 UNION ALL SELECT id, 1000 + rank FROM s4) GROUP BY id), "
    "al AS (SELECT id, 'entity' AS s, rank FROM s1 UNION ALL SELECT id, 'relation', rank FROM s2 UNION ALL SELECT id, 'evidence', row_number() OVER (ORDER BY x) FROM ef), "
    "fu AS (SELECT id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 8) AS score, string_agg(s, ',' ORDER BY s) AS reasons FROM al GROUP BY id) "
    "SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, reasons FROM fu ORDER BY score DESC, id LIMIT 1500",
    "retrieval_means": f"SELECT * EXCLUDE (query) FROM ({SEARCH_SQL['retrieval_metrics']})",
    "index_scores": f"WITH {_SCORES} SELECT *, round(0.35 * relation_recall + 0.2 * relation_precision + 0.15 + 0.1 * evidence_presence + 0.1 * attribution + 0.05 + 0.05 * span_completeness, 6) AS score FROM r",
}
