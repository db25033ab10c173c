"""Entity search: ranked streams over entities, relations, evidence and facts, to be fused by reciprocal ranks; and scores of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.text import tokens
from tidewake.operators.search import STREAM_ROWS, query_terms
from tidewake.operators.traverse import both_ends

#: Weights of an index's scores.
WEIGHTS = {
    "relation_recall": 0.35,
    "relation_precision": 0.2,
    "affected_recall": 0.15,
    "evidence_presence": 0.1,
    "attribution": 0.1,
    "pack_readiness": 0.05,
    "span_completeness": 0.05,
}


def holds(column: Column, text: str) -> Column:
    """Whether a column has the text, in any case of letters; % and _ are themselves, and a null has nothing."""
    return F.coalesce(F.contains(F.lower(column), F.lit(text.lower())), F.lit(False))


def _begins(column: str, word: str) -> Column:
    """Whether a token of an array begins with the word."""
    return F.exists(column, lambda x: x.startswith(word))


def _placed(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows with their rank. The window is over at most ``limit`` rows."""
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def entity_stream(entities: DataFrame, text: str, limit: int = STREAM_ROWS) -> DataFrame:
    """``(id, rank, ...)`` of entities whose id, path, name or symbol has the text, in this order of what matches, then files, name and id."""
    hits = {f"{c}_match": holds(F.col(c), text) for c in ("id", "path", "display_name", "symbol")}
    rows = entities.withColumns(hits)
    found = rows.where(" OR ".join(hits))
    order = [*[F.col(c).desc() for c in hits], (F.col("kind") == "file").desc(), F.col("display_name"), F.col("id")]
    return _placed(found.select("id", "display_name", "kind", *hits), order, limit).select("id", "rank", *hits)


def _most(counted: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """Counts (id, n, ...) of known entities by number, name and id."""
    named = counted.join(entities.select("id", "display_name"), "id")
    return _placed(named, [F.col("n").desc(), F.col("display_name"), F.col("id")], limit).drop("display_name")


def relation_stream(entities: DataFrame, relations: DataFrame, text: str, limit: int = STREAM_ROWS) -> DataFrame:
    """``(id, n, bucket, rank)`` of entities at an end of relations whose kind or provenance has the text; the bucket is their least kind."""
    ends = both_ends(relations.where(holds(F.col("kind"), text) | holds(F.col("provenance"), text)))
    return _most(ends.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("n"), F.min("kind").alias("bucket")), entities, limit)


def evidence_stream(entities: DataFrame, relations: DataFrame, evidence: DataFrame, text: str, limit: int = STREAM_ROWS, terms: bool = True) -> DataFrame:
    """``(id, n, bucket, rank)`` of entities at an end of relations with evidence for the text.

    Evidence counts if each term begins a token of its file, kind or snippet;
    if that finds none, the text is no query of terms, or ``terms`` is off, if
    one of the three has the text.
    """
    found, words = None, query_terms(text) if terms else None
    if words:
        t = tokens(F.concat_ws(" ", "file_path", "kind", "snippet"))
        of = evidence.withColumn("t", t)
        for w in words:
            of = of.where(_begins("t", w))
        found = of.drop("t")
    if found is None or found.isEmpty():
        found = evidence.where(holds(F.col("file_path"), text) | holds(F.col("kind"), text) | holds(F.col("snippet"), text))
    per = found.groupBy(F.col("relation_id").alias("id")).agg(F.count("*").alias("hits"))
    ends = both_ends(relations.join(per, "id"), "hits")
    return _most(ends.groupBy(F.col("entity").alias("id")).agg(F.sum("hits").alias("n"), F.min("kind").alias("bucket")), entities, limit)


def fact_stream(entities: DataFrame, seen: DataFrame, hidden: DataFrame, text: str, limit: int = STREAM_ROWS) -> DataFrame:
    """``(id, n, rank)`` of entities with facts for the terms: asserts ``seen`` in a scope, neither redacted nor ``hidden`` (id) there."""
    words = query_terms(text)
    live = seen.where("op = 'assert' AND NOT redacted").join(hidden, "id", "left_anti").select("id", "entity_id", "attribute", "value")
    if words:
        live = live.withColumn("t", tokens(F.concat_ws(" ", "entity_id", "attribute", "value")))
        for w in words:
            live = live.where(_begins("t", w))
    else:
        live = live.limit(0)
    return _most(live.groupBy(F.col("entity_id").alias("id")).agg(F.countDistinct("id").alias("n")), entities, limit)


def after(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(id, rank)`` of two streams in one list: all of the first before those of the second; an id keeps its best place."""
    both = first.select("id", F.lit(0).alias("list"), "rank").unionByName(second.select("id", F.lit(1).alias("list"), "rank"))
    best = both.groupBy("id").agg(F.min(F.struct("list", "rank")).alias("b"))
    return best.select("id", F.row_number().over(Window.orderBy("b")).alias("rank"))  # two streams' rows at most


def index_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row of relation recall and precision, evidence presence, span completeness and attribution.

    ``expected`` (source, target, kind, adapter), ``actual`` (source, target,
    kind, adapter, n_evidence, n_spans), each with an edge once. With nothing
    to find, a score is 1.
    """
    key = ["source", "target", "kind"]
    want = expected.select(*key, F.col("adapter").alias("wanted"), F.lit(True).alias("e"))
    both = want.join(actual.withColumn("a", F.lit(True)), key, "full_outer")
    hit = F.col("e") & F.col("a")
    counts = both.agg(
        F.count("e").alias("e"), F.count("a").alias("a"), F.count_if(hit).alias("hit"), F.count_if(hit & (F.col("n_evidence") > 0)).alias("proof"),
        F.count_if(hit & (F.col("n_spans") > 0)).alias("span"), F.count_if(hit & (F.col("adapter") == F.col("wanted"))).alias("own"),
    )
    ratio = lambda n, of: F.when(F.col(of) == 0, 1.0).otherwise(F.round(F.col(n) / F.col(of), 6))
    return counts.select(
        ratio("hit", "e").alias("relation_recall"), ratio("hit", "a").alias("relation_precision"), ratio("proof", "e").alias("evidence_presence"),
        ratio("span", "e").alias("span_completeness"), ratio("own", "e").alias("attribution"),
    )


def weighted_score(scores: DataFrame) -> DataFrame:
    """``scores`` with ``score``, the weighted sum of its seven columns."""
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return scores.withColumn("score", F.round(total, 6))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """One row of the means of all columns but ``query``; 1 where there is no query."""
    return metrics.agg(*[F.round(F.coalesce(F.avg(c), F.lit(1.0)), 6).alias(c) for c in metrics.columns if c != "query"])
