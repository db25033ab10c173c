"""Graph query plans to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.plans.cypher import Query, parse
from tidewake.session import if_small, stored


def like_pattern(value: str) -> str:
    """CONTAINS is a case-insensitive LIKE in which % and _ of the value are wildcards; a backslash is itself."""
    return "%" + value.replace("\\", "\\\\") + "%"


def reach(relations: DataFrame, least: int, most: int, starts: DataFrame | None = None) -> DataFrame:
    """``(start, node, depth)``, distinct, for paths of ``least`` to ``most`` hops along source to target.

    A level is a join with the distinct edges and is made distinct before the
    next, so cycles cost a row per depth at most. ``starts`` (id) bounds where
    paths begin. Edges and levels are stored, so that edges are made distinct
    once and a level's plan doesn't hold those before it.
    """
    edges = relations.select(F.col("source_entity_id").alias("start"), F.col("target_entity_id").alias("node")).distinct()
    edges = stored(edges) if most > 1 else edges
    first = edges.join(starts.select(F.col("id").alias("start")), "start", "left_semi") if starts is not None else edges
    steps = edges.select(F.col("start").alias("at"), F.col("node").alias("to"))
    level, out = first, None
    for depth in range(1, most + 1):
        if depth > 1:
            level = if_small(level).join(steps, level["node"] == steps["at"]).select("start", F.col("to").alias("node")).distinct()
        if depth < most:
            level = stored(level)
            if level.isEmpty():
                break
        if depth >= least:
            some = level.withColumn("depth", F.lit(depth))
            out = some if out is None else out.unionByName(some)
    return out if out is not None else first.withColumn("depth", F.lit(0)).limit(0)


def run(text: str, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows of a graph query; columns are named by the RETURN items."""
    q = parse(text)
    used: dict[str, set[str]] = {"source": {"id"}, "target": {"id"}}
    for item in [*q.items, *(c.item for c in q.where)]:
        side, column = q.column(item)
        if side != "rel":
            used[side].add(column)

    def nodes(side: str) -> DataFrame:
        node = q.source if side == "source" else q.target
        out = entities.where(F.lower("kind") == node.label.lower()) if node.label else entities
        for c in q.where:
            of, column = q.column(c.item)
            if of == side:
                out = out.where(_holds(F.col(column), c.contains, c.value))
        return out.select(*[F.col(c).alias(f"{side}_{c}") for c in sorted(used[side] | {"path"})])

    if q.rel is None:
        found, default = nodes("source"), ["source_path"]
    else:
        rows = relations.where(F.upper("kind") == q.rel.type.upper()) if q.rel.type else relations
        if q.rel.hops:
            bounded = any(q.column(c.item)[0] == "source" for c in q.where) or q.source.label
            starts = nodes("source").select(F.col("source_id").alias("id")) if bounded else None
            paths = reach(rows, *q.rel.hops, starts)
            found = paths.withColumnsRenamed({"start": "source_id", "node": "target_id"})
            default = ["source_path", "target_path"]
        else:
            for c in q.where:
                of, column = q.column(c.item)
                if of == "rel":
                    rows = rows.where(_holds(F.col(column), c.contains, c.value))
            found = rows.select(
                F.col("source_entity_id").alias("source_id"),
                F.col("target_entity_id").alias("target_id"),
                *[F.col(c).alias(f"rel_{c}") for c in ("kind", "confidence", "provenance")],
            )
            default = ["source_path", "target_path", "rel_kind"]
        found = found.join(nodes("source"), "source_id").join(nodes("target"), "target_id")
    of = lambda i: "_".join(q.column(i))
    keys = [i for i in q.items if not i.counted]
    if len(keys) < len(q.items):
        counts = [F.count(of(i)).alias(i.title) for i in q.items if i.counted]
        grouped = found.groupBy(*[F.col(of(i)).alias(i.title) for i in keys]).agg(*counts) if keys else found.agg(*counts)
        last = [F.col(f"`{i.title}`").asc_nulls_first() for i in keys]
    else:
        grouped = found.select(*[F.col(of(i)).alias(i.title) for i in q.items], *[F.col(c).alias(f"_{c}") for c in default])
        last = [F.col(f"_{c}").asc_nulls_first() for c in default]
    asked = [F.col(f"`{t}`").desc_nulls_last() if down else F.col(f"`{t}`").asc_nulls_first() for t, down in q.order]
    # The default keys come after what is asked for, so that a limit has one result.
    if asked or last:  # else one row
        grouped = grouped.orderBy(*asked, *last)
    return grouped.limit(q.limit).select(*[F.col(f"`{i.title}`") for i in q.items])


def _holds(column: Column, contains: bool, value: str) -> Column:
    return column.ilike(like_pattern(value)) if contains else column == value
