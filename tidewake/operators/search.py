"""Hybrid retrieval: ranked streams fused by reciprocal ranks, diversified, cut to a byte budget."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.text import tokens
from tidewake.session import stored

#: BM25's parameters and least idf, the rank offset of fusion, rows of a stream, terms of a query.
K1, B, LEAST_IDF, RRF, STREAM_ROWS, TERMS = 1.2, 0.75, 1e-6, 60, 500, 8
#: Byte budgets of results.
BUDGETS = {"brief": 5000, "standard": 12_000, "deep": 30_000}


def query_terms(text: str) -> list[str] | None:
    """Up to eight lower-case terms, or None if the text looks like a path or pattern and isn't for the index."""
    if re.search(r"[\\%_./:]", text):
        return None
    return re.findall(r"[a-z0-9]+", text.lower())[:TERMS] or None


def bm25(docs: DataFrame, text: str, limit: int = STREAM_ROWS) -> DataFrame:
    """``(id, score, rank)`` of documents (id, text) that have a token with each term as prefix; higher is better.

    Lengths, frequencies and the average are computed row by row, and the only
    exchange is a sum of one row per task: nothing is exploded or shuffled.
    """
    terms = query_terms(text)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    starting = lambda w: F.size(F.filter("t", lambda x: x.startswith(w)))
    counted = docs.select("id", tokens(F.col("text")).alias("t")).select(
        "id", F.size("t").alias("dl"), *[starting(w).alias(f"tf{k}") for k, w in enumerate(terms)]
    )
    totals = counted.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]
    )
    score = F.lit(0.0)
    found = F.lit(True)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        found = found & (tf > 0)
    hits = counted.crossJoin(F.broadcast(totals)).where(found).select("id", score.alias("score"))  # one row of totals
    return ranked(hits, limit)


def ranked(hits: DataFrame, limit: int = STREAM_ROWS) -> DataFrame:
    """The best ``limit`` rows of a stream (id, score) with their ranks; ties go to the smaller id."""
    top = hits.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def ranked_whole(hits: DataFrame) -> DataFrame:
    """All rows of ``hits`` (id, score, more) with their ranks; ties go to the smaller id.

    Rows are dealt out by ranges of that order and written, and a range's ranks
    start after the rows of the ranges before it: no task gathers all of them.
    """
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc("id")]
    rows = stored(hits.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))  # one row per range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return rows.join(F.broadcast(starts), "range").withColumn("rank", F.col("before") + inside).drop("range", "before")


def fuse(streams: dict[str, DataFrame]) -> DataFrame:
    """``(id, score, rank, reasons)``: reciprocal ranks of all streams (id, rank) added, to eight decimals; every id of a stream has a row."""
    rows = None
    for name, s in streams.items():
        one = s.select("id", F.lit(name).alias("stream"), F.col("rank").alias("r"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.groupBy("id", "stream").agg(F.min("r").alias("r"))
    added = best.groupBy("id").agg(
        F.round(F.sum(1 / (F.lit(RRF) + F.col("r"))), 8).alias("score"), F.concat_ws(",", F.sort_array(F.collect_set("stream"))).alias("reasons")
    )
    return ranked_whole(added)


def diversify(results: DataFrame, bucket: str, k: int) -> DataFrame:
    """The first ``k`` of (id, rank, bucket) taken in turn from the buckets, which come in order of their best rank.

    Fewer than three results, or one bucket only, stay in their own order. No
    bucket gives more than ``k``, so its later rows go before they are shuffled.
    """
    inside = Window.partitionBy(bucket).orderBy("rank")
    whole = Window.partitionBy(bucket)
    rows = results.withColumn("turn", F.row_number().over(inside)).where(F.col("turn") <= k)
    rows = rows.withColumn("first", F.min("rank").over(whole))
    if k < 3:
        rows = rows.withColumn("turn", F.lit(1))
    order = [F.col("turn"), F.col("first"), F.col("rank")]
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("turn", "first")


def within_budget(results: DataFrame, size: str, budget: str | int = "standard") -> DataFrame:
    """Results up to the place where their sizes in bytes, added up in order of ``place``, exceed the budget."""
    most = BUDGETS.get(budget, budget)
    total = F.sum(size).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("total", total).where(F.col("total") <= most)


def ranking_metrics(returned: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per query of ``relevant`` (query, id): recall at 5 and 10, precision at 5, reciprocal rank, and nDCG at 10 of ``returned`` (query, id, rank)."""
    hits = returned.join(relevant, ["query", "id"], "left_semi")
    per = hits.groupBy("query").agg(
        F.count_if(F.col("rank") <= 5).alias("h5"),
        F.count_if(F.col("rank") <= 10).alias("h10"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    total = relevant.groupBy("query").agg(F.countDistinct("id").alias("total"))
    gains = [sum(1 / math.log2(i + 2) for i in range(n)) for n in range(11)]
    ideal = F.element_at(F.array(*[F.lit(g) for g in gains]), F.least("total", F.lit(10)).cast("int") + 1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(per, "query", "left").select(
        "query",
        F.round(zero(F.col("h5") / F.col("total")), 6).alias("recall_5"),
        F.round(zero(F.col("h10") / F.col("total")), 6).alias("recall_10"),
        F.round(zero(F.col("h5") / F.lit(5)), 6).alias("precision_5"),
        F.round(zero(1 / F.col("first")), 6).alias("mrr"),
        F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg_10"),
    )
