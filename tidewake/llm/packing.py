"""Operator 8, packing: order-preserving dynamic programming over cut positions.

A task reads its documents in order as one token stream and cuts it into
sequences. Cuts lie at ends of documents or sentences; where the next such end
would waste more than ``CUT_WITHIN`` tokens, also at the full length. The
program minimises padding plus penalties; the best start of a full-length
window comes from a monotone queue.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Penalties in tokens of padding: for a sequence, for a cut inside a document, and for one inside a sentence.
SEQUENCE_COST, DOCUMENT_COST, SENTENCE_COST = 8, 2, 24
#: Padding beyond which a cut inside a sentence is considered.
CUT_WITHIN = 32
#: Least distance of sentence ends that are states.
CLOSEST = 12
#: Tokens that one run of the program sees; what its last windows leave goes to the next run.
CHUNK_TOKENS = 1_000_000


# --- tokens -----------------------------------------------------------------

#: The pre-tokenizer's pattern of byte-level BPE files (a fixed value of the public format).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Odd(dict):
    """Character -> whether libraries may class it differently: separators, unassigned ones and surrogates."""

    def __missing__(self, c: str) -> bool:
        self[c] = got = "\x1c" <= c <= "\x1f" or unicodedata.category(c) in ("Cn", "Cs")
        return got


class TextEncoder:
    """Ids of a byte-level BPE tokenizer's file, as ``tokenizers`` gives them without added special tokens.

    ``tiktoken`` applies the file's vocabulary, several times faster. A text
    with an odd character or a special token's string goes to ``tokenizers``
    itself, and so does every text if the file isn't of the kind described.
    ``breaks[i]``: whether the token i ends in a sentence's or a line's end.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, plain = spec["model"]["vocab"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.breaks = np.zeros(max(self.whole.get_vocab().values()) + 1, dtype=bool)
        self.breaks[[i for t, i in vocab.items() if t[-1] in ".!?\u010a"]] = True  # the last stands for the line feed
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ordered = [vocab["".join(m)] for m in merges]
        self.fast: tiktoken.Encoding | None = None
        if spec["normalizer"] is None and plain.items() <= spec["pre_tokenizer"].items() and ordered == sorted(ordered):
            ranks = {bytes(_byte_of()[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.fast, self.odd = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), _Odd()

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(map(self.odd.__getitem__, set(text))) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


# --- the dynamic program ----------------------------------------------------


def waste(length: int, limit: int) -> int:
    """Padding of a sequence: none at a power of two, else up to the limit."""
    return 0 if length & (length - 1) == 0 else limit - length


def _spaced(ends: np.ndarray) -> np.ndarray:
    """The first of the ends, and each that is at least ``CLOSEST`` after the last one taken."""
    out, free = [], 0
    for end in ends.tolist():
        if end >= free:
            out.append(end)
            free = end + CLOSEST
    return np.array(out, dtype=np.int64)


def plan_cuts(ends: np.ndarray, documents: np.ndarray, total: int, limit: int, final: bool) -> np.ndarray:
    """Positions where sequences end, the last at ``total`` if ``final``, else a window or two before it.

    ``ends``: increasing positions of sentence or document ends; ``documents``:
    those of documents. The states are these, and positions a full length after
    a state whose last end within reach is far. f(j) = least over i of f(i) +
    padding(j - i) + penalty(j): for most i padding is limit - j + i, so the
    least f(i) + i of those within reach is kept in a monotone queue; starts at
    half and at a quarter of the length, which need no padding, are looked up.
    Of sentence ends, one less than ``CLOSEST`` after the last that is a state is none.
    """
    last = int(documents[-1]) if len(documents) else 0
    where = np.union1d(_spaced(ends), documents) if len(ends) else documents
    where = where[(where > 0) & (where < total)]
    costs = np.where(np.isin(where, documents), SEQUENCE_COST, SEQUENCE_COST + DOCUMENT_COST).tolist()
    fixed = where.tolist()
    if final:
        fixed.append(total)
        costs.append(SEQUENCE_COST if last == total else SEQUENCE_COST + DOCUMENT_COST)
    inside, quarter, half, n = SEQUENCE_COST + SENTENCE_COST, limit // 4, limit // 2, len(fixed)
    f: dict[int, int] = {0: 0}
    back: dict[int, int] = {}
    keys, starts, head = [0], [0], 0  # the queue: f + position and position, both increasing
    extra: deque[int] = deque()
    at = reach = p = 0
    while True:
        if p + limit < total:  # p is a new state: what is the furthest end within its reach?
            while reach < n and fixed[reach] <= p + limit:
                reach += 1
            if p + limit - (fixed[reach - 1] if reach else 0) > CUT_WITHIN and (not extra or extra[-1] < p + limit):
                extra.append(p + limit)
        if extra and (at == n or extra[0] < fixed[at]):
            p, cost = extra.popleft(), inside
        elif at < n:
            p, cost = fixed[at], costs[at]
            at += 1
            if extra and extra[0] == p:
                extra.popleft()
        else:
            break
        while starts[head] < p - limit:
            head += 1
        value, start = keys[head] + limit - p, starts[head]
        if p - half in f and f[p - half] < value:
            start = p - half
            value = f[start]
        if p - quarter in f and f[p - quarter] < value:
            start = p - quarter
            value = f[start]
        value += cost
        f[p] = value
        back[p] = start
        key = value + p
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            starts.pop()
        keys.append(key)
        starts.append(p)
    if final:
        p = total
    else:
        p = min((q for q in back if q > total - 3 * limit), key=lambda q: f[q] - q, default=0)
    cuts = []
    while p:
        cuts.append(p)
        p = back[p]
    cuts = cuts[::-1]
    if final and cuts:
        cuts = cuts[:-1] + _tail(cuts[-2] if len(cuts) > 1 else 0, total, limit)
    return np.array(cuts, dtype=np.int64)


def _tail(start: int, end: int, limit: int) -> list[int]:
    """The last sequence, cut at powers of two where that costs less than its padding."""
    n = end - start
    if waste(n, limit) <= (n.bit_count() - 1) * SEQUENCE_COST:
        return [end]
    out = []
    for k in range(n.bit_length() - 1, -1, -1):
        if n >> k & 1:
            start += 1 << k
            out.append(start)
    return out


# --- operator ---------------------------------------------------------------

_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
]


def _pack(
    batches: Iterator[pa.RecordBatch], path: str, limit: int, with_ids: bool, end_id: int
) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), np.array([end_id], dtype="<u4")
    sequence = TaskContext.get().partitionId() << 40
    docs: list[tuple[int | None, int, int]] = []  # id, ids of the document before this buffer, its ids in all
    parts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    lengths: list[int] = []
    total = 0

    def run(final: bool) -> pa.RecordBatch | None:
        nonlocal docs, parts, ends, lengths, total, sequence
        buffer = np.concatenate(parts)
        bounds = np.cumsum(lengths)
        cuts = plan_cuts(np.concatenate(ends), bounds, total, limit, final)
        if not len(cuts):
            return None
        done = int(cuts[-1])
        marks = np.union1d(cuts, bounds[bounds <= done])
        begin = np.concatenate([[0], marks[:-1]])
        doc = np.searchsorted(bounds, begin, "right")
        seq = np.searchsorted(cuts, begin, "right")
        first = np.concatenate([[0], bounds[:-1]])
        seq_start = np.concatenate([[0], cuts[:-1]])
        before = np.array([d[1] for d in docs])
        out = [
            pa.array([docs[k][0] for k in doc], pa.int64()),
            pa.array(begin - first[doc] + before[doc], pa.int64()),
            pa.array(marks - begin, pa.int64()),
            pa.array([zlib.crc32(buffer[a:b]) for a, b in zip(begin.tolist(), marks.tolist(), strict=True)], pa.int64()),
            pa.array([docs[k][2] for k in doc], pa.int64()),
            pa.array(sequence + seq, pa.int64()),
            pa.array(begin - seq_start[seq], pa.int64()),
        ]
        names = [n for n, _ in _FIELDS]
        if with_ids:
            values = pa.array(buffer[:done].astype("<i4"), pa.int32())
            out.append(pa.ListArray.from_arrays(pa.array(np.append(begin, done), pa.int32()), values))
            names.append("ids")
        sequence += len(cuts)
        left = int(np.searchsorted(bounds, done, "right"))  # the first document with ids to come
        if left < len(docs):
            used = done - int(first[left])
            docs = [(docs[left][0], docs[left][1] + used, docs[left][2]), *docs[left + 1 :]]
            lengths = [lengths[left] - used, *lengths[left + 1 :]]
        else:
            docs, lengths = [], []
        inner = np.concatenate(ends) - done
        ends, parts, total = [inner[inner > 0]], [buffer[done:]], total - done
        return pa.RecordBatch.from_arrays(out, names)

    for batch in batches:
        for i in range(batch.num_rows):
            ids = encode(batch.column(1)[i].as_py() or "")
            n = len(ids) + 1
            docs.append((batch.column(0)[i].as_py(), 0, n))
            parts += (ids, end)
            ends.append(np.flatnonzero(encode.breaks[ids]) + (total + 1))
            lengths.append(n)
            total += n
            if total >= CHUNK_TOKENS and (out := run(False)):
                yield out
    if total and (out := run(True)):
        yield out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int = 1024,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``limit`` (a power of two) tokens.

    Ids are integers (a string is read as one; what is none raises). Columns: doc_id,
    start (ids of the document before the piece), length,
    ids_crc32 (of the piece's little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset (in the sequence, gapless from 0), and with
    ``with_ids`` the ids themselves. A document is its text's ids and then
    ``end_id``; every id is in one piece. A null or empty text is ``end_id``
    alone, a null id stays null, repeated rows are packed each; an empty table
    gives an empty table.

    Each task packs the rows of its own partition in their order, so nothing
    is shuffled, a task holds about ``CHUNK_TOKENS`` tokens, and a lost task is
    packed anew with the same result. Sequence ids: the partition's number
    times 2^40, plus a count.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    fn = partial(_pack, path=tokenizer_path, limit=limit, with_ids=with_ids, end_id=end_id)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        fn, schema + ", ids array<int>" * with_ids
    )
