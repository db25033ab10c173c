"""Vectors: quantisation, dot products, exact nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantise(vector: Column) -> Column:
    """Components cut to [-1, 1] and scaled to -127..127, halves rounded up."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127 + 0.5).cast("int"))


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


#: Vectors and queries of a block that one task compares.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024


def _best(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of a block of vectors for each of a block of queries; shorter vectors are filled up with zeros."""
    out = []
    if len(asked) and len(held):
        sides = (asked["q"], held["vector"])
        dims = max(len(x) for side in sides for x in side)
        q, v = (np.array([np.pad(np.asarray(x, dtype=float), (0, dims - len(x))) for x in side]) for side in sides)
        scores, ids = q @ v.T, held["id"].to_numpy()
        for query, row in zip(asked["query"], scores, strict=True):
            at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
            at = sorted(at, key=lambda i: (-row[i], ids[i]))[:k]  # noqa: B023
            out += [(query, ids[i], row[i]) for i in at]
    return pd.DataFrame(out, columns=["query", "id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query, id, score, rank)``: the ``k`` vectors (id, model, vector) of highest dot product for each query (query, model, vector).

    Both sides are dealt into blocks by hash, and a task compares one block of
    vectors with one of queries of the same model, so neither is broadcast or
    gathered. Only a block's best leave it. Ties go to the smaller id; null
    vectors are no vectors.
    """
    v, q = (side.where("vector IS NOT NULL AND model IS NOT NULL") for side in (vectors, queries))
    parts = [max(1, -(-side.count() // most)) for side, most in ((v, BLOCK_VECTORS), (q, BLOCK_QUERIES))]
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = v.select("id", "model", "vector", place("id", parts[0]).alias("vb"), every(parts[1]).alias("qb"))
    asked = q.select("query", "model", F.col("vector").alias("q"), every(parts[0]).alias("vb"), place("query", parts[1]).alias("qb"))
    schema = f"query {queries.schema['query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    key = ["model", "vb", "qb"]
    best = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(lambda a, b: _best(a, b, k), schema)
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def stub_embedding(text: Column, dims: int = 768) -> Column:
    """Deterministic stand-in for a model: bytes of chained SHA-256 digests of the text, minus 128."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                block, made = hashlib.sha256((t or "").encode()).digest(), b""
                while len(made) < dims:
                    made += block
                    block = hashlib.sha256(block).digest()
                out.append([b - 128 for b in made[:dims]])
            yield pd.Series(out, dtype=object)

    return of(text)
