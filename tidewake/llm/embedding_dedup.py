"""Operator 10, embedding near-dedup with an inverted multi-index.

Two codebooks, one per half of the vectors, form a grid of cells. Each vector
is a member of its nearest cell and visits its nearest cells in order of summed
distance, up to the distance that a calibration asks for. A pair meets where one visits the
other's cell, and its cosine is then taken in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidewake.llm._shared import small, written
from tidewake.llm.components import smallest_of_components
from tidewake.llm.simhash import _forest

#: Different vectors that the codebooks are fitted on, for each centroid and at least; centroids of a codebook at most. With
#: 192 members in a cell that is enough for 12 billion different vectors; beyond them cells grow.
PER_CENTROID, LEAST_SAMPLE, MOST_CENTROIDS = 20, 20_000, 8192
#: Members of a cell on average that a grid may have at most, and how many compared members a visit's shuffled row is worth.
PER_CELL, VISIT_COST = 1024, 1000
#: Share of pairs at the threshold itself that the traversal is to find; closer pairs are found more often.
TARGET_RECALL, TRIALS = 0.985, 1500
#: A task compares this many members with this many visitors at most.
MEMBERS, VISITORS = 1024, 4096
#: Distances that are held at once.
_AT_ONCE = 1 << 22


@dataclass
class MultiIndex:
    """Centroids of either half; a vector visits cells at most ``margin`` further than its own, ``visits`` at most."""

    left: np.ndarray
    right: np.ndarray
    visits: int
    margin: float = np.inf

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest cells of each unit vector, nearest first, and their distances (less the vector's own length).

        The multi-sequence order of the grid: with the halves' centroids ranked,
        a cell at ranks (a, b) has (a + 1)(b + 1) - 1 cells at least as near, so
        that only cells with (a + 1)(b + 1) <= n can be among the first n.
        """
        half, k = self.left.shape[1], len(self.right)
        reach = [min(k, n // (i + 1)) for i in range(min(len(self.left), n))]
        a, b = np.repeat(np.arange(len(reach)), reach), np.concatenate([np.arange(r) for r in reach])
        cells, far = [], []
        for at in range(0, len(x), max(1, _AT_ONCE // (len(a) + 2 * k))):
            part = x[at : at + max(1, _AT_ONCE // (len(a) + 2 * k))]
            d = [(c * c).sum(axis=1) - 2 * h @ c.T for h, c in ((part[:, :half], self.left), (part[:, half:], self.right))]
            rank = [np.argsort(m, axis=1, kind="stable") for m in d]
            near = [np.take_along_axis(m, r, axis=1) for m, r in zip(d, rank, strict=True)]
            sums = near[0][:, a] + near[1][:, b]
            first = np.argsort(sums, axis=1, kind="stable")[:, :n]
            cells.append((rank[0][np.arange(len(part))[:, None], a[first]] * k + rank[1][np.arange(len(part))[:, None], b[first]]).astype(np.int32))
            far.append(np.take_along_axis(sums, first, axis=1))
        return np.concatenate(cells), np.concatenate(far)

    def visited(self, x: np.ndarray) -> np.ndarray:
        """Cells that each vector visits, its own first, filled up with -1."""
        cells, far = self.nearest(x, self.visits)
        return np.where(far <= far[:, :1] + self.margin, cells, -1).astype("<i4")


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = (-2 * x @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def grid_sizes(rows: int) -> list[int]:
    """Centroids of either codebook that are tried: from the fewest that cells of ``PER_CELL`` members need, by doubling."""
    low = int(np.clip(np.ceil((rows / PER_CELL) ** 0.5), 1, MOST_CENTROIDS))
    return sorted({min(low * f, MOST_CENTROIDS) for f in (1, 2, 4)})


def fit_index(sample: np.ndarray, rows: int, cosine: float, recall: float = TARGET_RECALL, seed: int = 3) -> MultiIndex:
    """Codebooks by k-means on sampled unit vectors; the traversal's margin by pairs at the threshold itself.

    Of the grids tried, the first whose finer neighbour costs more: a visit
    costs a shuffled row and the comparison with a cell's members.
    """
    best, least = None, np.inf
    for k in grid_sizes(rows):
        index, mean = _calibrated(sample, min(k, len(sample)), cosine, recall, np.random.default_rng(seed))
        cost = mean * (VISIT_COST + rows / (len(index.left) * len(index.right)))
        if cost >= least:
            break
        best, least = index, cost
    return best


def _calibrated(sample: np.ndarray, k: int, cosine: float, recall: float, rng: np.random.Generator) -> tuple[MultiIndex, float]:
    """An index of k centroids a half, and how many cells a vector visits on average.

    The calibration turns sampled vectors by exactly the threshold's angle in
    random directions and takes the least margin with which either side
    reaches the other's cell in ``recall`` of the pairs.
    """
    half = sample.shape[1] // 2
    index = MultiIndex(_centroids(sample[:, :half], k, rng), _centroids(sample[:, half:], k, rng), 1)
    if k == 1:
        return index, 1.0
    x = sample[rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)]
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    y = cosine * x + np.sqrt(1 - cosine * cosine) * turn
    most = min(k * k, 64)
    while True:
        (cx, dx), (cy, dy) = (index.nearest(v, most) for v in (x, y))
        needs = []
        for cells, far, other in ((cx, dx, cy), (cy, dy, cx)):
            hit = cells == other[:, :1]
            needs.append(np.where(hit.any(axis=1), far[np.arange(len(far)), hit.argmax(axis=1)] - far[:, 0], np.inf))
        need = np.sort(np.minimum(*needs))
        margin = need[min(len(need) - 1, int(np.ceil(recall * len(need))))]
        inside = (dx <= dx[:, :1] + margin).sum(axis=1)
        if most == k * k or (np.isfinite(margin) and inside.max() < most):
            index.margin, index.visits = float(margin), int(inside.max())
            return index, float(inside.mean())
        most = min(k * k, most * 4)


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that isn't zero."""
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(vectors: pd.Series, kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v, dtype=kind) for v in vectors]).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(batches: Iterator[pd.DataFrame], cosine: float, kind: str = "<f8") -> Iterator[pd.DataFrame]:
    """Per key, members come first and then visitors: counts of links by node, and edges that connect what links connect."""
    members: dict | None = None
    cols = ["cell", "mb", "vb"]
    for b in batches:
        if not len(b):
            continue
        at = b[cols].to_numpy()
        bounds = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(b)]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):  # runs of a key, in the order of the rows
            key, rows = tuple(at[start]), b.iloc[start:end]
            new, asking = rows[rows["role"] == 0], rows[rows["role"] == 1]
            if members is None or members["key"] != key:
                members = {"key": key, "parts": []}
            if len(new):
                seen = np.stack([np.frombuffer(v, dtype="<i4") for v in new["visited"]])
                members["parts"].append((new["node"].to_numpy(), new["n"].to_numpy(), _units(new["vec"], kind), seen))
            if not len(asking) or not members["parts"]:
                continue
            if len(members["parts"]) > 1:
                members["parts"] = [tuple(np.concatenate(p) for p in zip(*members["parts"], strict=True))]
            node, n, unit, seen = members["parts"][0]
            who, copies, own = (asking[c].to_numpy() for c in ("node", "n", "own"))
            q, m = np.nonzero(_units(asking["vec"], kind) @ unit.T >= cosine)
            q, m = (lambda keep: (q[keep], m[keep]))(who[q] != node[m])
            if not len(q):
                continue
            back = ~(seen[m] == own[q][:, None]).any(axis=1)  # the member doesn't come to the visitor's cell
            ids = np.concatenate([who[q], node[m[back]]])
            at_id, inverse = np.unique(ids, return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([n[m], copies[q[back]]])).astype(np.int64)
            child, root = _forest([(who[q], node[m])])
            yield pd.DataFrame(
                {"a": np.concatenate([at_id, child]), "b": np.concatenate([np.full(len(at_id), -1), root]),
                 "links": np.concatenate([count, np.zeros(len(child), np.int64)])}
            )


def _linked(nodes: DataFrame, cosine: float, recall: float, kind: str) -> DataFrame:
    """Counts (b = -1) and forest edges (links = 0) among the rows ``(node, n, vec)`` of one length."""
    spark = nodes.sparkSession
    rows = nodes.count()
    wanted = max(LEAST_SAMPLE, PER_CENTROID * grid_sizes(rows)[-1])
    share = F.pmod(F.xxhash64("vec", F.lit("sample")), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, wanted / max(rows, 1))))
    sample = nodes.where(share).select("vec").orderBy(F.xxhash64("vec")).toPandas()["vec"]
    if not len(sample):
        sample = nodes.select("vec").limit(1).toPandas()["vec"]
    shared = spark.sparkContext.broadcast(fit_index(_units(sample, kind), rows, cosine, recall))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: MultiIndex = shared.value
        for b in batches:
            cells = index.visited(_units(b["vec"], kind))
            yield b.assign(own=cells[:, 0], visits=[c[c >= 0] for c in cells], visited=[c.tobytes() for c in cells])

    schema = "node long, n long, vec binary, own int, visits array<int>, visited binary"
    placed = written(nodes.select("node", "n", "vec").mapInPandas(assign, schema))
    asked = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    held = placed.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("members"))
    # cells without members have nothing to visit
    sizes = written(
        held.join(asked, "cell").select(
            "cell",
            F.ceil(F.col("members") / MEMBERS).cast("int").alias("gm"),
            F.ceil(F.col("visitors") / VISITORS).cast("int").alias("gv"),
        )
    )
    place = lambda salt, groups: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.col(groups) - 1))
    of = ["cell", "node", "n", "vec", "own"]
    members = placed.withColumn("cell", F.col("own")).join(small(sizes), "cell").select(
        *of, "visited", F.lit(0).alias("role"), place("m", "gm").alias("mb"), every("gv").alias("vb")
    )
    visitors = placed.withColumn("cell", F.explode("visits")).join(small(sizes), "cell").select(
        *of, F.lit(None).cast("binary").alias("visited"), F.lit(1).alias("role"), every("gm").alias("mb"), place("v", "gv").alias("vb")
    )
    dealt = members.unionByName(visitors)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(partitions, "cell", "mb", "vb")
        .sortWithinPartitions("cell", "mb", "vb", "role")
        .mapInPandas(lambda it: _compare(it, cosine, kind), "a long, b long, links long")
    )


def embedding_links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = 0.9, recall: float = TARGET_RECALL
) -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` per row of ``vectors``.

    ``n_links``: other rows found whose cosine in double precision is at least
    ``cosine``; ``component_id``: smallest id reachable by links, itself
    included; ``kept``: whether the row has that id. Equal vectors are one
    entry of the index and always link. Vectors of different lengths don't
    link, and neither do null, empty and zero ones, those with a null or
    non-finite component, and rows with a null id (their component is null and
    they aren't kept). Rows that repeat an id and a vector link with each other
    and are kept alike. An empty table gives an empty table.

    Links are found if one side's traversal reaches the other's cell, and count
    for both sides whichever finds them. Full cells are compared in blocks of
    ``MEMBERS`` by ``VISITORS``; counts and a spanning forest leave the tasks,
    not pairs.
    """
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, FloatType) else "<f8"
    v = F.col(vector_col).cast("array<double>")
    fine = usable(v) & F.col(id_col).isNotNull()
    base = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), _binary(F.when(fine, v), kind).alias("vec")))
    grouped = base.where("vec IS NOT NULL").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "first", "n", "vec", F.octet_length("vec").alias("dims")))
    found = None
    for r in nodes.select("dims").distinct().orderBy("dims").collect():
        some = _linked(nodes.where(F.col("dims") == r.dims), cosine, recall, kind)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = base.sparkSession.createDataFrame([], "a long, b long, links long")
    found = written(found)
    counts = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    smallest = smallest_of_components(found.where("b >= 0").select("a", "b").distinct(), nodes.select("node", "first"))
    linked = (
        nodes.join(small(written(counts)), "node", "left")
        .join(small(smallest), "node", "left")
        .where("n > 1 OR links IS NOT NULL")
        .select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "first").alias("component_id"))
    )
    out = base.join(small(written(linked)), "vec", "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        own.alias("component_id"),
        F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def _binary(v: Column, kind: str) -> Column:
    """Vector as little-endian floats of its own precision, in which it is exact; minus zero is zero."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series([None if x is None else (np.asarray(x, dtype=kind) + 0).astype(kind).tobytes() for x in vectors], dtype=object)

    return of(v)
