"""Queries over the graph views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.confidence import RANK_SQL, gate, rank
from tidewake.operators import cochange, traverse
from tidewake.plans.graph_views import ENTITIES_SQL, RELATIONS_SQL, entities, evidence, relations, table
from tidewake.plans.lower import run

GRAPH_SQL = f"{ENTITIES_SQL}, {RELATIONS_SQL}"

#: Query texts, the names that their columns get, and their SQL over the views.
CYPHER: dict[str, tuple[str, list[str], str]] = {
    "cypher_most_referenced": (
        "MATCH (a)-[r:PLACED_BY]->(b) RETURN b.path, COUNT(a) ORDER BY COUNT(a) DESC, b.path LIMIT 10",
        ["path", "n"],
        "SELECT t.path, count(s.id) AS n FROM relations r JOIN entities s ON s.id = source_entity_id "
        "JOIN entities t ON t.id = target_entity_id WHERE upper(r.kind) = 'PLACED_BY' GROUP BY t.path "
        "ORDER BY n DESC, path LIMIT 10",
    ),
    "cypher_one_hop": (
        "MATCH (a:Orders)-[r:PLACED_BY]->(b:customer) WHERE r.confidence = 'heuristic' RETURN a.id, b.path, r.kind, r.provenance",
        ["id", "path", "kind", "provenance"],
        "SELECT s.id, t.path, r.kind, r.provenance FROM relations r JOIN entities s ON s.id = source_entity_id "
        "JOIN entities t ON t.id = target_entity_id WHERE r.kind = 'PLACED_BY' AND r.confidence = 'heuristic' "
        "AND s.kind = 'orders' AND t.kind = 'customer' ORDER BY s.path, t.path, r.kind LIMIT 1000",
    ),
    "cypher_reverse_hop": (
        "MATCH (n:nation)<-[r:located_in]-(s:supplier) WHERE n.name CONTAINS 'nation_1' RETURN n.name, s.name ORDER BY s.name DESC LIMIT 50",
        ["nation", "supplier"],
        "SELECT t.display_name AS nation, s.display_name AS supplier FROM relations r JOIN entities s ON s.id = source_entity_id "
        "JOIN entities t ON t.id = target_entity_id WHERE r.kind = 'LOCATED_IN' AND s.kind = 'supplier' AND t.kind = 'nation' "
        "AND t.display_name ILIKE '%nation_1%' ORDER BY supplier DESC LIMIT 50",
    ),
    "cypher_paths": (
        "MATCH (a:supplier)-[*1..3]->(b) RETURN a.path, b.path LIMIT 10000",
        ["source", "target"],
        "SELECT s.path AS source, t.path AS target FROM reach JOIN entities s ON s.id = a JOIN entities t ON t.id = b WHERE s.kind = 'supplier' "
        "ORDER BY 1, 2 LIMIT 10000",
    ),
    "cypher_nodes": (
        "MATCH (p:part) WHERE p.path CONTAINS 'T/_1' RETURN p.id, p.name LIMIT 10000",
        ["id", "name"],
        "SELECT id, display_name AS name FROM entities WHERE kind = 'part' AND path ILIKE '%T/_1%' ORDER BY path LIMIT 10000",
    ),
    "cypher_count": (
        "MATCH (a)-[r]->(b) RETURN COUNT(a), COUNT(b.symbol)",
        ["n", "n_symbol"],
        "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_symbol FROM relations",
    ),
    "cypher_group": (
        "MATCH (a)-[r]->(b) RETURN r.kind, r.confidence, COUNT(a) ORDER BY r.kind DESC",
        ["kind", "confidence", "n"],
        "SELECT kind, confidence, count(*) AS n FROM relations GROUP BY ALL",
    ),
}
_REACH = (
    "reach(a, b, depth) AS (SELECT source_entity_id, target_entity_id, 1 FROM relations UNION SELECT a, target_entity_id, depth + 1 "
    "FROM reach JOIN relations ON source_entity_id = b WHERE depth < 3)"
)


def _cypher(name: str):
    text, names, _ = CYPHER[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(text, entities(spark, sf_dir), relations(spark, sf_dir)).toDF(*names)

    return query


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).where("kind = 'region'").select(F.col("id").alias("seed"))


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes of every region reach within three steps."""
    rows = traverse.impact_rows(entities(spark, sf_dir), relations(spark, sf_dir), _regions(spark, sf_dir), 3, 200)
    return traverse.affected(rows).select("seed", "path", F.col("depth").cast("long").alias("depth"), "confidence", "kind")


EDGES = (
    "edges AS (SELECT target_entity_id AS node, source_entity_id AS source, path, r.kind, r.confidence, r.id FROM relations r "
    "JOIN entities e ON e.id = source_entity_id QUALIFY row_number() OVER (PARTITION BY target_entity_id ORDER BY path, r.kind, r.id) <= 200)"
)
_WALK = (
    "walk(seed, node, depth) AS (SELECT id, id, 0 FROM entities WHERE kind = 'region' UNION "
    "SELECT seed, source, depth + 1 FROM walk JOIN edges USING (node) WHERE depth < 2)"
)
_AFFECTED = f"""affected AS (
    SELECT seed, path, CAST(depth + 1 AS BIGINT) AS depth, confidence, kind FROM walk JOIN edges USING (node)
    QUALIFY row_number() OVER (PARTITION BY seed, path ORDER BY depth, {RANK_SQL} DESC, kind, id) = 1)"""


def impact_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = blast_radius(spark, sf_dir).where("seed = 'region:0'").select("confidence")
    out = None
    for level in ("any", "none", "proven", "inferred", "heuristic"):
        one = gate(hit, level).select(F.lit(level).alias("level"), "failed")
        out = one if out is None else out.unionByName(one)
    return out


def impact_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blast_radius(spark, sf_dir)
    return traverse.page(rows, [F.col("seed"), *traverse.impact_order()], 100, 50)


def evidence_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every relation with its first evidence row."""
    rows = traverse.first_evidence(relations(spark, sf_dir), evidence(spark, sf_dir))
    return rows.select("id", "kind", "evidence_id", "snippet")


_EVIDENCE = (
    "evidence AS (SELECT left(sha1(relation_id || ':' || snippet), 20) AS id, * FROM (SELECT left(sha1('CONTAINS:orders:' || CAST(l_orderkey AS VARCHAR) || "
    "':part:' || CAST(l_partkey AS VARCHAR) || ':line:' || CAST(l_linenumber AS VARCHAR)), 20) AS relation_id, "
    "'ship ' || strftime(l_shipdate, '%Y-%m-%d') || ' ' || l_returnflag || ' ' || l_linestatus AS snippet FROM lineitem))"
)


def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five relations of every entity in each direction."""
    return traverse.neighbourhood(relations(spark, sf_dir), 5)


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.explain(entities(spark, sf_dir), relations(spark, sf_dir), evidence(spark, sf_dir))


_ENDS = (
    "ends AS (SELECT source_entity_id AS entity, target_entity_id AS other, id, kind, true AS outgoing FROM relations "
    "UNION ALL SELECT target_entity_id, source_entity_id, id, kind, false FROM relations WHERE source_entity_id <> target_entity_id)"
)


def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = entities(spark, sf_dir).where("kind IN ('orders', 'supplier', 'nation')")
    return traverse.induced_subgraph(relations(spark, sf_dir), nodes)


def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = entities(spark, sf_dir).where("kind = 'nation'").select(
        F.col("id").alias("seed"), F.row_number().over(traverse.Window.partitionBy("kind").orderBy("path")).alias("seed_rank")
    )
    found = traverse.proximity(relations(spark, sf_dir), seeds, 30)
    return found.select("entity", F.col("seed_rank").cast("long").alias("seed_rank"))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path")
    )


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.round("score", 6))


def co_change_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cochange.co_changes(_baskets(spark, sf_dir), min_count=2, min_score=0.05))


def co_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cochange.co_changes(_event_days(spark, sf_dir)))


def _event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), day).alias("commit"), F.col("event_type").alias("path"))


def co_change_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cochange.partners(cochange.co_changes(_event_days(spark, sf_dir)), "click", 3))


def co_change_strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cochange.strongest_partner(cochange.co_changes(_event_days(spark, sf_dir))))


def trace_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' shipments observed: lines returned confirm that the order holds the part."""
    rows = relations(spark, sf_dir, ("CONTAINS", "SUPPLIED_BY"))
    observed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.concat(F.lit("orders:"), F.col("l_orderkey").cast("string")).alias("source"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"),
    )
    raised, counts = cochange.promote(rows, observed)
    by_kind = raised.groupBy("kind", "confidence").agg(F.count("*").alias("n"))
    return by_kind.crossJoin(counts)  # one row of counts


def _co_sql(files: str, count: int, score: float) -> str:
    return f"""commits AS ({files}),
    files AS (SELECT DISTINCT commit, path FROM commits),
    kept AS (SELECT * FROM files QUALIFY count(*) OVER (PARTITION BY commit) <= 25),
    freq AS (SELECT path, count(*) AS n FROM kept GROUP BY path),
    pairs AS (SELECT x.path AS source, y.path AS target, count(*) AS co_changes FROM kept x JOIN kept y USING (commit)
              WHERE x.path <> y.path GROUP BY ALL HAVING count(*) >= {count}),
    co AS (SELECT source, target, co_changes, round(co_changes / greatest(f.n, g.n), 6) AS score FROM pairs
           JOIN freq f ON f.path = source JOIN freq g ON g.path = target WHERE co_changes / greatest(f.n, g.n) >= {score})"""


_PARTS = _co_sql("SELECT l_orderkey AS commit, 'part/' || CAST(l_partkey AS VARCHAR) AS path FROM lineitem", 2, 0.05)
_DAYS = _co_sql("SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS commit, event_type AS path FROM events", 3, 0.3)

QUERIES = {name: _cypher(name) for name in CYPHER} | {
    "blast_radius": blast_radius,
    "impact_gates": impact_gates,
    "impact_page": impact_page,
    "evidence_pick": evidence_pick,
    "neighbourhood": neighbourhood,
    "explain_entities": explain,
    "subgraph_export": subgraph,
    "graph_proximity": proximity,
    "co_change_parts": co_change_parts,
    "co_change_events": co_change_events,
    "co_change_partners": co_change_partners,
    "co_change_strongest": co_change_strongest,
    "trace_promotion": trace_promotion,
}

_BLAST = f"WITH RECURSIVE {GRAPH_SQL}, {EDGES}, {_WALK}, {_AFFECTED} "
ORACLES = {
    name: f"WITH RECURSIVE {GRAPH_SQL}, {_REACH} {sql}" if "reach" in sql else f"WITH {GRAPH_SQL} {sql}"
    for name, (_, _, sql) in CYPHER.items()
} | {
    "blast_radius": _BLAST + "SELECT * FROM affected",
    "impact_gates": _BLAST
    + f", top AS (SELECT max({RANK_SQL}) AS r FROM affected WHERE seed = 'region:0') SELECT level, coalesce(r, -1) >= least AND level <> 'none' AS failed "
    "FROM top, (VALUES ('any', 0), ('none', 9), ('proven', 3), ('inferred', 2), ('heuristic', 1)) AS v(level, least)",
    "impact_page": _BLAST + f"SELECT * FROM affected ORDER BY seed, {RANK_SQL} DESC, depth, path LIMIT 50 OFFSET 100",
    "evidence_pick": f"WITH {GRAPH_SQL}, {_EVIDENCE}, f AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY id) = 1) "
    "SELECT r.id, kind, f.id AS evidence_id, snippet FROM relations r LEFT JOIN f ON relation_id = r.id",
    "neighbourhood": f"WITH {GRAPH_SQL}, {_ENDS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity, outgoing ORDER BY kind, other, id) AS rn, "
    "count(*) OVER (PARTITION BY entity, outgoing) AS total FROM ends) SELECT entity, outgoing, kind, other, id, total > 5 AS truncated FROM k WHERE rn <= 5",
    "explain_entities": f"WITH {GRAPH_SQL}, {_EVIDENCE}, {_ENDS}, p AS (SELECT relation_id, count(*) AS n FROM evidence GROUP BY relation_id), "
    "c AS (SELECT entity, count(*) FILTER (WHERE outgoing) AS n_out, count(*) FILTER (WHERE NOT outgoing) AS n_in, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_evidence, "
    "count(DISTINCT other) AS n_neighbours FROM ends LEFT JOIN p ON relation_id = id GROUP BY entity) "
    "SELECT id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_neighbours, 0) AS n_neighbours "
    "FROM entities LEFT JOIN c ON entity = id",
    "subgraph_export": f"WITH {GRAPH_SQL}, n AS (SELECT id FROM entities WHERE kind IN ('orders', 'supplier', 'nation')) SELECT source_entity_id, target_entity_id, kind, confidence "
    "FROM relations WHERE source_entity_id IN (SELECT id FROM n) AND target_entity_id IN (SELECT id FROM n) "
    f"QUALIFY row_number() OVER (PARTITION BY source_entity_id, target_entity_id, kind ORDER BY {RANK_SQL} DESC) = 1",
    "graph_proximity": f"WITH {GRAPH_SQL}, {_ENDS}, s AS (SELECT id AS seed, row_number() OVER (ORDER BY path) AS seed_rank FROM entities WHERE kind = 'nation'), "
    "d AS (SELECT DISTINCT seed, seed_rank, other FROM s JOIN ends ON entity = seed), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY seed ORDER BY other) <= 30) "
    "SELECT other AS entity, min(seed_rank) AS seed_rank FROM k GROUP BY other",
    "co_change_parts": f"WITH {_PARTS} SELECT * FROM co",
    "co_change_events": f"WITH {_DAYS} SELECT * FROM co",
    "co_change_partners": f"WITH {_DAYS} SELECT * FROM co WHERE source = 'click' ORDER BY score DESC, co_changes DESC, target LIMIT 3",
    "co_change_strongest": f"WITH {_DAYS} SELECT target, source, co_changes, score FROM co QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, co_changes DESC, source DESC) = 1",
    "trace_promotion": f"WITH {GRAPH_SQL}, o AS (SELECT DISTINCT 'orders:' || CAST(l_orderkey AS VARCHAR) AS s, 'part:' || CAST(l_partkey AS VARCHAR) AS t FROM lineitem WHERE l_returnflag = 'R'), "
    "r AS (SELECT * FROM relations WHERE kind IN ('CONTAINS', 'SUPPLIED_BY')), "
    "h AS (SELECT kind, CASE WHEN s IS NULL THEN confidence ELSE 'proven' END AS confidence FROM r LEFT JOIN o ON s = source_entity_id AND t = target_entity_id), "
    "e AS (SELECT source_entity_id AS s, target_entity_id AS t, count(*) FILTER (WHERE confidence <> 'proven') AS a, count(*) FILTER (WHERE confidence = 'proven') AS d FROM r GROUP BY ALL), "
    "n AS (SELECT CAST(coalesce(sum(a), 0) AS BIGINT) AS promoted, CAST(coalesce(sum(d), 0) AS BIGINT) AS already_proven, count(*) FILTER (WHERE a IS NULL) AS unmatched FROM o LEFT JOIN e USING (s, t)) "
    "SELECT g.*, n.* FROM (SELECT kind, confidence, count(*) AS n FROM h GROUP BY ALL) g, n",
}
__all__ = ["ORACLES", "QUERIES", "rank"]
