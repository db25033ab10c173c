"""Blast radius, neighbourhoods, evidence picks and exports over the graph views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.confidence import rank
from tidewake.session import if_small, stored

#: Least, default and most of the traversal's limits.
DEPTH, FANOUT = (1, 2, 8), (1, 200, 2000)


def bounded(value: int | float | None, limits: tuple[int, int, int]) -> int:
    """A parameter cut to a whole number and into its limits; the default if it is missing or no number."""
    least, default, most = limits
    if value is None or value != value:
        return default
    return int(min(max(value, least), most))


def incoming(entities: DataFrame, relations: DataFrame, fanout: int) -> DataFrame:
    """``(node, source, path, kind, confidence, id)``: the first ``fanout`` relations into each node.

    In order of the source's path, kind and id; sources without a path don't
    count. Spark limits each group before the shuffle, so a hub's relations
    meet in one task as many times ``fanout`` only.
    """
    into = relations.join(
        entities.where("path IS NOT NULL").select(F.col("id").alias("source_entity_id"), "path"), "source_entity_id"
    )
    order = Window.partitionBy("target_entity_id").orderBy("path", "kind", "id")
    ranked = into.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= fanout)
    return ranked.select(
        F.col("target_entity_id").alias("node"), F.col("source_entity_id").alias("source"), "path", "kind", "confidence", "id"
    )


def impact_rows(
    entities: DataFrame, relations: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_fanout: int | None = None
) -> DataFrame:
    """``(seed, node, source, path, kind, confidence, id, depth)`` for all ``seeds`` (seed) together.

    Breadth first against the relations' direction. A node is expanded once, at
    its smallest depth; a relation into a node already seen, the seed included,
    is still reported. A level reads the relations once and shuffles only those
    into its frontier; each level is stored.
    """
    depth, fanout = bounded(max_depth, DEPTH), bounded(max_fanout, FANOUT)
    frontier = stored(seeds.select("seed", F.col("seed").alias("node")).distinct())
    visited, out = frontier, None
    for level in range(1, depth + 1):
        nodes = if_small(stored(frontier.select(F.col("node").alias("target_entity_id")).distinct()))
        edges = incoming(entities, relations.join(nodes, "target_entity_id", "left_semi"), fanout)
        rows = stored(if_small(frontier).join(edges, "node").withColumn("depth", F.lit(level)))
        out = rows if out is None else out.unionByName(rows)
        if level < depth:
            frontier = stored(
                rows.select("seed", F.col("source").alias("node")).distinct().join(visited, ["seed", "node"], "left_anti")
            )
            if frontier.isEmpty():
                break
            visited = visited.unionByName(frontier)
    return out


def affected(rows: DataFrame) -> DataFrame:
    """``(seed, path, depth, confidence, kind)``: the best row of each path, of the least depth and then highest confidence."""
    best = F.struct(F.col("depth"), (-rank(F.col("confidence"))).alias("r"), F.col("kind"), F.col("id"), F.col("confidence"))
    picked = rows.groupBy("seed", "path").agg(F.min(best).alias("b"))
    return picked.select("seed", "path", "b.depth", "b.confidence", "b.kind")


def impact_order() -> list[Column]:
    """Confidence down, then depth and path."""
    return [rank(F.col("confidence")).desc(), F.col("depth"), F.col("path")]


def first_evidence(relations: DataFrame, evidence: DataFrame, most: int = 1) -> DataFrame:
    """Relations with their first ``most`` evidence rows (by id), those without kept with nulls."""
    if most == 1:  # a minimum is taken before the shuffle, a window's rows are not
        picked = evidence.groupBy("relation_id").agg(F.min(F.struct("id", "file_path", "snippet")).alias("e")).select("relation_id", "e.*")
    else:
        order = Window.partitionBy("relation_id").orderBy("id")
        picked = evidence.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    return relations.join(
        picked.select("relation_id", F.col("id").alias("evidence_id"), "file_path", "snippet"),
        relations["id"] == F.col("relation_id"),
        "left",
    ).drop("relation_id")


def both_ends(relations: DataFrame, *more: str) -> DataFrame:
    """``(entity, other, id, kind, provenance, outgoing)`` and columns ``more``: a row for each end of a relation, one only for a loop."""
    out = relations.select(
        F.col("source_entity_id").alias("entity"), F.col("target_entity_id").alias("other"), "id", "kind", "provenance", F.lit(True).alias("outgoing"), *more
    )
    into = relations.where("source_entity_id <> target_entity_id").select(
        F.col("target_entity_id").alias("entity"), F.col("source_entity_id").alias("other"), "id", "kind", "provenance", F.lit(False).alias("outgoing"), *more
    )
    return out.unionByName(into)


def neighbourhood(relations: DataFrame, limit: int = 100) -> DataFrame:
    """Per entity and direction the first ``limit`` relations (by kind, other end, id), and whether there are more."""
    ends = both_ends(relations)
    by = Window.partitionBy("entity", "outgoing").orderBy("kind", "other", "id")
    probed = ends.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= limit + 1)
    cut = probed.where(F.col("rn") == limit + 1).select("entity", "outgoing", F.lit(True).alias("cut"))
    return (
        probed.where(F.col("rn") <= limit)
        .join(cut, ["entity", "outgoing"], "left")
        .select("entity", "outgoing", "kind", "other", "id", F.coalesce("cut", F.lit(False)).alias("truncated"))
    )


def explain(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per entity: relations in and out, evidence rows, and distinct neighbours.

    Evidence is joined to relations, before each becomes two ends.
    """
    proof = evidence.groupBy(F.col("relation_id").alias("id")).agg(F.count("*").alias("n"))
    counted = both_ends(relations.join(proof, "id", "left"), "n").groupBy("entity").agg(
        F.count_if("outgoing").alias("n_out"),
        F.count_if(~F.col("outgoing")).alias("n_in"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_evidence"),
        F.countDistinct("other").alias("n_neighbours"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities.join(counted, entities["id"] == counted["entity"], "left").select(
        "id", zero("n_out"), zero("n_in"), zero("n_evidence"), zero("n_neighbours")
    )


def induced_subgraph(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations both of whose ends are in ``nodes`` (id); of those alike in ends and kind, the most confident."""
    kept = if_small(stored(nodes.select("id").distinct()))
    source, target = (kept.select(F.col("id").alias(c)) for c in ("source_entity_id", "target_entity_id"))
    inside = relations.join(source, "source_entity_id", "left_semi").join(target, "target_entity_id", "left_semi")
    best = F.max(F.struct(rank(F.col("confidence")).alias("r"), "confidence"))
    return inside.groupBy("source_entity_id", "target_entity_id", "kind").agg(best.alias("b")).select(
        "source_entity_id", "target_entity_id", "kind", F.col("b.confidence").alias("confidence")
    )


def proximity(relations: DataFrame, seeds: DataFrame, per_seed: int) -> DataFrame:
    """``(entity, seed_rank)``: direct neighbours of the seeds ``(seed, seed_rank)``, at most ``per_seed`` each; the best seed's rank."""
    ends = both_ends(relations).where("entity <> other")
    near = ends.join(if_small(stored(seeds)), ends["entity"] == F.col("seed")).select("seed", "seed_rank", "other").distinct()
    by = Window.partitionBy("seed").orderBy("other")
    kept = near.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= per_seed)
    return kept.groupBy(F.col("other").alias("entity")).agg(F.min("seed_rank").alias("seed_rank"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int = 100) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given total order."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)
