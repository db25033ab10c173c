"""Operator 5, line dedup by winnowing over hashes of lines and, inside long lines, of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import small, written

#: A line gram is this many lines in sequence; of so many line grams in sequence the least hash is selected.
GRAM_LINES, WINDOW_LINES = 2, 2
#: The same for words.
GRAM_WORDS, WINDOW_WORDS = 24, 27
#: Words of the shortest passage that certainly holds a selected word gram. Line grams are shorter than this.
PASSAGE_WORDS = GRAM_WORDS + WINDOW_WORDS - 1
#: Bytes of text that are hashed at once, if a text isn't longer.
_AT_ONCE = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_POWERS = np.multiply.accumulate(np.array([1] + [_BASE] * 0xFFFF, dtype="<u8"))


# --- fingerprints -----------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_FIRST)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_SECOND)
    return h ^ (h >> np.uint64(32))


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of each run of ``values``; runs follow each other and none is empty."""
    if not len(sizes):
        return np.zeros(0, "<u8")
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(values)) - np.repeat(first, sizes)
    sums = np.add.reduceat((values + np.uint64(1)) * _POWERS[at & 0xFFFF], first)
    return _mixed(sums + sizes.astype("<u8"))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k values in sequence, by doubling; shorter than ``h`` by k - 1."""
    have, size, done, out = h, 1, 0, None
    while True:
        if k & size:
            if out is None:
                out, done = have, size
            else:
                n = len(h) - done - size + 1
                out = out[: max(n, 0)] * np.uint64(pow(_BASE, size, 1 << 64)) + have[done : done + max(n, 0)]
                done += size
        if done == k:
            return _mixed(out)
        n = max(len(have) - size, 0)
        have = have[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + have[size : size + n]
        size *= 2


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the least (of equal ones the last) of every w values in sequence, by doubling."""
    better = lambda a, b: np.where(g[b] <= g[a], b, a)
    at, size = np.arange(len(g)), 1
    while size * 2 <= w:
        at = better(at[:-size], at[size:])
        size *= 2
    return better(at[: len(at) - (w - size)], at[w - size :]) if w > size else at


def winnowed(g: np.ndarray, valid: np.ndarray, doc: np.ndarray, w: int) -> np.ndarray:
    """Places of the window minima: per stretch of valid hashes of a document, of every w in sequence, or of all if it is shorter."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at
    key, of = g[at], doc[at]
    stretch = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (of[1:] != of[:-1])]))
    picks = []
    if len(at) >= w:
        least = _least(key, w)
        picks.append(least[stretch[: len(least)] == stretch[w - 1 :]])
    alone = np.flatnonzero(np.bincount(stretch)[stretch] < w)
    if len(alone):
        order = alone[np.lexsort((-alone, key[alone], stretch[alone]))]
        picks.append(order[np.diff(stretch[order], prepend=-1) != 0])
    return at[np.unique(np.concatenate(picks))]


def selected(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Fingerprints of texts: hash, number of the text, first word, words, whether of lines.

    Words are runs of other bytes than 20 and 09-0D. Lines without a word
    count for nothing. A line gram of ``PASSAGE_WORDS`` or more words is none,
    since its words have a fingerprint.
    """
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    inside = ~_BLANK[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    doc = np.searchsorted(begins, starts, "right") - 1
    before = np.searchsorted(doc, np.arange(len(texts)))
    words = _summed(data[inside].astype("<u8"), ends - starts)

    found = []
    if len(words) >= GRAM_WORDS:
        g = _rolled(words, GRAM_WORDS)
        of = doc[: len(g)]
        at = winnowed(g, of == doc[GRAM_WORDS - 1 :], of, WINDOW_WORDS)
        found.append((g[at], of[at], at - before[of[at]], np.full(len(at), GRAM_WORDS), np.zeros(len(at), bool)))
    lines = np.flatnonzero(np.diff(np.cumsum(data == 10)[starts], prepend=-1)) if len(starts) else starts
    if len(lines) >= GRAM_LINES:
        sizes = np.diff(np.append(lines, len(words)))
        g = _rolled(_summed(words, sizes), GRAM_LINES)
        of = doc[lines]
        n = np.convolve(sizes, np.ones(GRAM_LINES, dtype=np.int64), "valid")
        at = winnowed(g, (of[: len(g)] == of[GRAM_LINES - 1 :]) & (n < PASSAGE_WORDS), of[: len(g)], WINDOW_LINES)
        found.append((~g[at], of[at], lines[at] - before[of[at]], n[at], np.ones(len(at), bool)))
    if not found:
        return tuple(np.zeros(0, t) for t in ("<u8", np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        start = size = 0
        for k, t in enumerate(texts):
            texts[k] = t.encode("utf-8", "replace")
            size += len(texts[k]) + 1
            if size < _AT_ONCE and k + 1 < len(texts):
                continue
            h, of, p, n, lines = selected(texts[start : k + 1])
            at = pa.array(of + start, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view("<i8")), batch.column("doc").take(at), batch.column("tag").take(at),
                 pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(lines)],
                ["fp", "doc", "tag", "p", "n", "lines"],
            )
            texts[start : k + 1] = [None] * (k + 1 - start)
            start, size = k + 1, 0


# --- extension --------------------------------------------------------------


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands before, in and after each asked fingerprint of a text, as far as the next one may be; words joined by blanks."""
    for b in batches:
        rows = []
        for text, asked in zip(b["text"], b["asked"], strict=True):
            w = text.encode("utf-8", "replace").split()
            for a in asked:
                p, end = a["p"], a["p"] + a["n"]
                reach = PASSAGE_WORDS if a["lines"] else WINDOW_WORDS
                rows.append((a["fp"], *(b" ".join(x) for x in (w[max(0, p - reach) : p], w[p:end], w[end : end + reach]))))
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=["fp", "left", "own", "right"])
                rows = []
        yield pd.DataFrame(rows, columns=["fp", "left", "own", "right"])


def _agree(a: list[bytes], b: list[bytes]) -> int:
    """Number of equal items at the beginning."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the first words of lines and the number of words."""
    a = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff((~_BLANK[a]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.append(np.flatnonzero(np.diff(np.cumsum(a == 10)[starts], prepend=-1)), len(starts))


def extended(text: str, runs: list[dict]) -> list[tuple[int, int]]:
    """Word ranges of the repeated runs of a text.

    A run has its first and last fingerprint's place and length, and what
    stands there, before and after in their first occurrence. It counts if the
    words of both are equal, and is extended to either side as far as words
    agree; from a line gram by whole lines.
    """
    data = text.encode("utf-8", "replace")
    words, lines = data.split(), _word_bounds(data)[2]
    gone: list[tuple[int, int]] = []
    for r in runs:
        s, last, e = r["s"], r["last"], r["last"] + r["last_n"]
        if b" ".join(words[s : s + r["first_n"]]) != r["own"] or b" ".join(words[last:e]) != r["last_own"]:
            continue  # equal hashes of different words
        left, right = r["left"].split(), r["right"].split()
        low = s - _agree(words[max(r["floor"], s - len(left)) : s][::-1], left[::-1])
        high = e + _agree(words[e : e + len(right)], right)
        if r["first_lines"]:
            low = int(lines[np.searchsorted(lines, low)])
        if r["last_lines"]:
            high = int(lines[np.searchsorted(lines, high, "right") - 1])
        gone.append((low, high))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(gone):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _extensions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [extended(t, list(r)) for t, r in zip(b["text"], b["runs"], strict=True)]
        gone = pd.Series([[{"first": f, "end": e} for f, e in g] for g in got], dtype=object, index=b.index)
        yield pd.DataFrame({"doc": b["doc"], "tag": b["tag"], "gone": gone})


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without some word ranges, and without what follows them up to the next word, or precedes them at the end."""
    data = text.encode("utf-8", "replace")
    starts, ends, _ = _word_bounds(data)
    kept, at = [], 0
    for low, high in gone:
        to_end = high == len(starts)
        cut = (int(ends[low - 1]) if low else 0) if to_end else int(starts[low])
        kept.append(data[at:cut])
        at = len(data) if to_end else int(starts[high])
    return b"".join([*kept, data[at:]]).decode("utf-8", "replace")


def _without(text: Column, gone: Column) -> Column:
    """``without`` as a column; null where there are no ranges."""

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, given in batches:
            yield pd.Series([None if g is None else without(t, [(r["first"], r["end"]) for r in g]) for t, g in zip(texts, given, strict=True)], dtype=object)

    return of(F.when(gone.isNotNull(), text), gone)


# --- operator ---------------------------------------------------------------


def repeated_runs(base: DataFrame) -> DataFrame:
    """``(doc, tag, gone)``: word ranges of the texts of ``base`` (doc, tag, text) that repeat earlier ones.

    Fingerprints that occur once are dropped by a count of hashes alone. The
    places of the others are joined with the fingerprint's first place, a
    pre-aggregated minimum, so no pairs of occurrences are made. What of a
    document's later occurrences overlaps or adjoins is one run. Only the two
    fingerprints at a run's ends bring the words of their first occurrence
    along, to be compared and extended.
    """
    doc_type = base.schema["doc"].dataType.simpleString()
    found = written(base.mapInArrow(_fingerprints, f"fp long, doc {doc_type}, tag long, p int, n int, lines boolean"))
    often = written(found.groupBy("fp").agg(F.count("*").alias("times")).where("times > 1").select("fp"))
    near = written(found.join(small(often), "fp", "left_semi"))
    first = written(near.groupBy("fp").agg(F.min(F.struct("doc", "tag", "p", "n", "lines")).alias("a")))
    same = (F.col("doc") == F.col("a.doc")) & (F.col("tag") == F.col("a.tag"))
    beyond = F.col("a.p") + F.col("a.n")
    later = near.join(small(first), "fp").where(~same | (F.col("p") >= beyond))
    later = later.select("doc", "tag", "fp", "p", "n", "lines", F.when(same, beyond).otherwise(0).alias("floor"))

    in_order = Window.partitionBy("doc", "tag").orderBy("p", "n", "fp")
    reached = F.max(F.col("p") + F.col("n")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("p") <= reached, 0).otherwise(1))
    later = later.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(
        later.groupBy("doc", "tag", "run")
        .agg(
            F.min(F.struct("p", "n", "fp", "lines", "floor")).alias("x"),
            F.max(F.struct((F.col("p") + F.col("n")).alias("end"), "p", "n", "fp", "lines")).alias("y"),
        )
        .select(
            "doc", "tag", F.col("x.fp").alias("from_fp"), F.col("x.p").alias("s"), F.col("x.n").alias("first_n"), F.col("x.lines").alias("first_lines"),
            F.col("x.floor").alias("floor"), F.col("y.fp").alias("to_fp"), F.col("y.p").alias("last"), F.col("y.n").alias("last_n"), F.col("y.lines").alias("last_lines"),
        )
    )

    ends = written(runs.select(F.col("from_fp").alias("fp")).unionByName(runs.select(F.col("to_fp").alias("fp"))).distinct())
    asked = first.join(small(ends), "fp").select("fp", "a.*").groupBy("doc", "tag").agg(F.collect_list(F.struct("fp", "p", "n", "lines")).alias("asked"))
    around = base.join(small(written(asked)), ["doc", "tag"]).select("text", "asked")
    around = written(around.mapInPandas(_contexts, "fp long, left binary, own binary, right binary").dropDuplicates(["fp"]))
    around = small(around)
    whole = runs.join(around.select(F.col("fp").alias("from_fp"), "left", "own"), "from_fp").join(
        around.select(F.col("fp").alias("to_fp"), F.col("own").alias("last_own"), "right"), "to_fp"
    )
    of_doc = whole.groupBy("doc", "tag").agg(F.collect_list(F.struct(*[c for c in whole.columns if c not in ("doc", "tag", "from_fp", "to_fp")])).alias("runs"))
    hit = small(written(runs.select("doc", "tag").distinct()))
    texts = base.join(hit, ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"])
    compared = texts.join(small(written(of_doc)), ["doc", "tag"]).mapInPandas(_extensions, f"doc {doc_type}, tag long, gone array<struct<first:int,end:int>>")
    return written(compared.where(F.size("gone") > 0))


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated runs of lines and words; ``ld_deleted``, an array of word ranges (first, end), is added.

    A run goes where the same words occurred before, in order of ids and
    places. The first occurrence stays, and so does what overlaps it in the
    same document. Found for certain are

    * a run of three lines or more (lines without a word aren't counted),
    * a run of ``PASSAGE_WORDS`` words or more, wherever it begins and ends in
      its lines: of it at least what lies between its first and last selected
      gram, and all of it unless another text had a part of it still earlier.

    Shorter runs, of two lines or of ``GRAM_WORDS`` words, go if their hash was
    selected. The words at both ends of a run are compared with those of the
    first occurrence before it goes: a hash alone decides only on a gram that
    lies between such ends. Words are equal if their bytes are; what separates
    them isn't compared.

    Texts without such a run, empty and null ones stay as they are. A row with
    a null id stays and counts as no occurrence. Rows that repeat an id and a
    text are one document and lose the same; rows of one id and different
    texts are different documents. An empty table gives an empty table. A
    column named ``ld_deleted`` is replaced; others may have any name.
    """
    text, of = F.col(text_col).cast("string"), F.col(id_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), of.alias("doc"), text.alias("text")).withColumn("tag", F.xxhash64("text"))
    base = rows.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "tag", "text")
    rows = rows.join(small(repeated_runs(base)), ["doc", "tag"], "left")
    out = rows.select("row", "gone", _without(F.col("text"), F.col("gone")).alias("new"))
    new = F.when(F.col("gone").isNotNull(), F.col("new")).otherwise(F.col(f"row.`{text_col}`"))
    own = [(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != "ld_deleted"]
    none = F.array().cast("array<struct<first:int,end:int>>")
    return out.select(*own, F.coalesce("gone", none).alias("ld_deleted"))
