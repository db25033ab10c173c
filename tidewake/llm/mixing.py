"""Operator 3, mixing sources to target weights.

Each source's documents are dealt into blocks by hash. Its quota, in blocks,
is split among output shards by a tree of multivariate-hypergeometric draws.
Shards then take disjoint runs of the source's permuted blocks, and rows are
shuffled inside their shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import small, written

#: Words: runs of anything but blanks and 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in order of code points, repeating; and how often a document is taken at most.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
#: Documents of a block on average, and parts that a source, or a block that has to be divided, is dealt into at most.
PER_BLOCK, MOST_BLOCKS = 64, 4096
#: Different documents of a partly taken block up to which one task fills it; a larger block is divided again.
FILL_ROWS = 4096
#: Part of a source's target up to which whole documents may miss it; a document is cut otherwise.
TOLERANCE = 0.002
#: Words of a shard that one task shuffles on average; larger shards are dealt to several tasks, in order.
TASK_WORDS = 10_000_000


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Source:
    """What the mix takes of a source: ``whole`` passes over all its blocks, then ``rest`` words."""

    name: str | None
    size: int
    blocks: int
    target: float
    whole: int
    rest: int


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, times: int = MOST_TIMES) -> dict:
    """Target of each source: its weight's share of all sizes, at most ``times`` its size, the excess reshared by weight."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[k % len(weights)] for k, (name, _) in enumerate(ordered)}
    size, total = dict(ordered), sum(n for _, n in ordered)
    capped: set = set()
    while True:
        open_ = [s for s in weight if s not in capped]
        left, shares = total - sum(times * size[s] for s in capped), sum(weight[s] for s in open_)
        got = {s: left * weight[s] / shares for s in open_}
        above = {s for s in open_ if got[s] > times * size[s]}
        if not above:
            return got | {s: float(times * size[s]) for s in capped}
        capped |= above


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) for each shard (row), by a tree of multivariate-hypergeometric draws.

    A node's blocks are a multiset of sources; its left shards get a random
    part of it, drawn without replacement, of the size that they hold. Column
    sums are the quotas exactly, and shards' sums differ by one at most.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = int(quotas.sum())
    bound = [total * k // shards for k in range(shards + 1)]
    rng = np.random.default_rng(seed)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        left = rng.multivariate_hypergeometric(have, bound[middle] - bound[low], method="marginals")
        todo += [(low, middle, left), (middle, high, have - left)]
    return out


def _fill(rows: pd.DataFrame, tolerance: float, seed: int) -> pd.DataFrame:
    """Words to take of documents of a source's last, partly taken block, so that they come to ``need``.

    Largest first, a document is taken whole if it still fits. If more than the
    tolerated part of the target is missing then, one further document is cut.
    """
    need, target = int(rows["need"].iloc[0]), float(rows["target"].iloc[0])
    order = sorted(
        zip(rows["key"], rows["size"], rows["n"], strict=True),
        key=lambda r: (-r[1], zlib.crc32(f"{seed}:{r[0]}".encode()), r[0]),
    )
    taken, left, over = [], need, []
    for key, size, n in order:
        if 0 < size * n <= left:
            taken.append((key, size, size))
            left -= size * n
        elif size:
            over.append((key, size, n))
    if left > tolerance * target and over:
        key, size, n = min(over, key=lambda r: (r[1] < left, r[2], r[1]))
        if words := min(size, left // n):
            taken.append((key, size, words))
    return pd.DataFrame([(rows["source"].iloc[0], *t) for t in taken], columns=["source", "key", "size", "words"])


def draws(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    shards: int = 64,
    seed: int = 11,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_draws`` added.

    ``mix_draws``: array of (epoch, shard, words), one entry for each time that
    the mix takes the row, empty if it doesn't. ``words`` is the row's size,
    but for at most one document per source, which is cut to its first words
    where whole documents can't come near the target. A null text has no
    words; a null source is a source like others; repeated rows are taken
    alike, and rows with a null id are told apart by their texts; sources
    without words are taken nothing of; an empty table gives an empty table.
    Columns of ``docs`` with one of the four names are replaced, others may
    have any name. The same rows give the same draws, however partitioned.

    One row per source and the quotas (sources by shards) are on the driver: a
    source is a category of a mixture. Everything else stays with the rows:
    block sums are pre-aggregated, and the rows get their draws by joins with
    small tables, hinted for broadcast only after being measured.
    """
    out = _drawn(docs, id_col, text_col, source_col, shards, seed, tolerance)[0]
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in out.columns[1:]]
    return out.select(*own, *out.columns[1:])


def _drawn(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, shards: int, seed: int, tolerance: float
) -> tuple[DataFrame, int]:
    """``row`` (a row of docs) with the columns that ``draws`` adds, and the number of words that the mix takes."""
    spark = docs.sparkSession
    text = F.col(text_col)
    by_text = F.concat(F.lit("text "), F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), F.lit(" "), F.coalesce(F.octet_length(text), F.lit(-1)).cast("string"))
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(id_col).cast("string"), by_text).alias("key"),
        size_in_words(text).alias("size"),
    )
    sizes = written(base.drop("row"))
    sources = _sources(sizes)
    divided: dict[str | None, list[list[int]]] = {s.name: [] for s in sources}
    while True:  # more than once only if a partly taken block is too large for one task
        blocked = _blocks(spark, sources, divided, seed)
        blocks = written(_needs(blocked(sizes), seed))
        partly = (F.col("need") > 0) & (F.col("need") < F.col("words"))
        last = small(written(blocks.where(partly).select("source", "block", "need")))
        pool = _join(blocked(sizes), last, ["source", "block"]).groupBy("source", "block", "key", "size", "need", "target")
        pool = written(pool.agg(F.count("*").alias("n")))
        large = pool.groupBy("source", "block").agg(F.countDistinct("key").alias("n")).where(F.col("n") > FILL_ROWS).collect()
        if not large:
            break
        for r in large:
            divided[r["source"]].append(list(r["block"]))
    picks = written(
        pool.groupBy("source").applyInPandas(lambda rows: _fill(rows, tolerance, seed), "source string, key string, size long, words long")
    )

    # A unit is a block taken once. Each source's units, permuted, go to the shards in runs as long as their quotas.
    none = F.array().cast("array<int>")
    epochs = F.concat(
        F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(none),
        F.when(F.col("need") > 0, F.array("whole")).otherwise(none),
    )
    units = written(blocks.select("source", "block", "whole", partly.alias("cut"), F.explode(epochs).alias("epoch")))
    quota = {r.source: r.n for r in units.groupBy("source").agg(F.count("*").alias("n")).collect()}
    tree = split_quotas(np.array([quota.get(s.name, 0) for s in sources], dtype=np.int64), shards, seed)
    ends = spark.createDataFrame(
        [(s.name, np.cumsum(tree[:, k]).tolist()) for k, s in enumerate(sources)], "source string, ends array<long>"
    )
    turn = Window.partitionBy("source").orderBy(F.xxhash64("block", "epoch", F.lit(seed + 2)), "block", "epoch")
    ranked = _join(units.withColumn("at", F.row_number().over(turn) - 1), small(written(ends)), ["source"])
    unit = F.struct(
        "epoch",
        F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"),
        (F.col("cut") & (F.col("epoch") == F.col("whole"))).alias("partly"),
    )
    dealt = written(ranked.groupBy("source", "block").agg(F.sort_array(F.collect_list(unit)).alias("units")))

    rows = _join(blocked(base), small(dealt), ["source", "block"], "left")
    rows = _join(rows, small(picks), ["source", "key", "size"], "left")
    made = F.transform(
        F.coalesce("units", F.array().cast("array<struct<epoch:int,shard:int,partly:boolean>>")),
        lambda u: F.struct(
            u["epoch"].alias("epoch"),
            u["shard"].alias("shard"),
            F.when(u["partly"], F.coalesce("words", F.lit(0))).otherwise(F.col("size")).alias("words"),
        ),
    )
    out = rows.select(
        "row",
        F.col("size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.filter(made, lambda d: d["words"] > 0).alias("mix_draws"),
    )
    return out, sum(s.whole * s.size + s.rest for s in sources)


def _blocks(spark, sources: list[Source], divided: dict, seed: int) -> Callable[[DataFrame], DataFrame]:
    """What adds to rows their source's plan and their block: a part of the source, then of each divided block that holds the row."""
    plan = spark.createDataFrame(
        [(s.name, s.size, s.blocks, s.target, s.whole, s.rest, divided[s.name]) for s in sources],
        "source string, source_size long, blocks int, target double, whole int, rest long, divided array<array<int>>",
    )
    plan, depth = small(written(plan)), max(map(len, divided.values()), default=0)

    def blocked(rows: DataFrame) -> DataFrame:
        block = F.array(F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")).cast("int"))
        for k in range(depth):
            part = F.pmod(F.xxhash64("key", F.lit(seed + 10 + k)), F.lit(MOST_BLOCKS)).cast("int")
            block = F.when(block == F.get("divided", F.lit(k)), F.concat(block, F.array(part))).otherwise(block)
        return _join(rows, plan, ["source"]).withColumn("block", block).drop("divided", "blocks")

    return blocked


def _needs(rows: DataFrame, seed: int) -> DataFrame:
    """Words of each block and ``need``, what is left of its source's rest when its turn comes in permuted order.

    Parts of a divided block come where it stood, so what came before is as before.
    """
    sums = rows.groupBy("source", "block", "whole", "rest", "target").agg(F.sum("size").alias("words"))
    order = F.transform("block", lambda b: F.xxhash64(b, F.lit(seed + 1)))
    permuted = Window.partitionBy("source").orderBy(order, "block")
    return sums.withColumn("need", F.col("rest") - F.sum("words").over(permuted) + F.col("words"))


def _sources(sizes: DataFrame) -> list[Source]:
    """What the mix takes of each source, in order of code points."""
    stats = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    goal, out = targets([(r["source"], r["size"]) for r in stats]), []
    for r in sorted(stats, key=lambda r: (r["source"] is None, r["source"] or "")):
        t, n = goal[r["source"]], r["size"]
        whole = min(int(t // n), MOST_TIMES) if n else 0
        blocks = min(MOST_BLOCKS, -(-r["docs"] // PER_BLOCK))
        out.append(Source(r["source"], n, blocks, t, whole, max(0, round(t) - whole * n)))
    return out


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of both, equal nulls included, that keeps the left ones."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = [left[c].eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(named, match, how).drop(*[f"_r_{c}" for c in on])


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    shards: int = 64,
    seed: int = 11,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """The mixture: a row of ``docs`` for each draw, with ``mix_epoch``, ``mix_shard`` and ``mix_words``.

    Rows are dealt to tasks by shard and are in shuffled order inside it. A
    shard of more than TASK_WORDS words is dealt to several tasks by ranges of
    that order, so that a task's size doesn't grow with the corpus. The text of
    a cut document is its first ``mix_words`` words with what stands between
    them. See ``draws`` for the rest; of columns of ``docs`` only those with one
    of the three names are replaced.
    """
    drawn, total = _drawn(docs, id_col, text_col, source_col, shards, seed, tolerance)
    parts = max(1, -(-total // (shards * TASK_WORDS)))
    rows = drawn.select("row", "mix_size", F.explode("mix_draws").alias("draw"))
    text = F.col(f"row.`{text_col}`")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), "")
    cut = F.when(F.col("draw.words") < F.col("mix_size"), first).otherwise(text)
    place = F.xxhash64(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != text_col]), "draw.epoch", F.lit(seed))
    added = {"mix_epoch": "epoch", "mix_shard": "shard", "mix_words": "words"}
    return (
        rows.withColumn("text", cut)
        .withColumn("place", F.shiftrightunsigned(place, 1))
        .withColumn("part", F.floor(F.shiftrightunsigned("place", 31) * parts / F.lit(1 << 32)).cast("int"))
        .repartition(shards * parts, "draw.shard", "part")
        .sortWithinPartitions("draw.shard", "place")
        .select(
            *[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in added],
            *[F.col(f"draw.{v}").alias(k) for k, v in added.items()],
        )
    )
