"""Operator 9, SimHash near-dedup with generalised pigeonhole search.

Bits are grouped into parts, correlated ones together. Part i gets a threshold
t_i >= -1 with sum(t_i + 1) = d + 1: two fingerprints at d or fewer differing
bits then differ in at most t_i bits of some part i. Which parts and thresholds
is a dynamic program over the estimated numbers of probes and candidates, from
bit counts over all fingerprints. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import small, written
from tidewake.llm.components import connected_components, smallest_of_components

#: What a probe's row and a compared pair cost, in microseconds; only their ratio counts.
PROBE_COST, PAIR_COST = 2.0, 0.02
#: Index rows of a key up to which one task compares them; a larger key is dealt out in blocks of this size.
BLOCK_ROWS = 16_384
_AT_ONCE = 1 << 16


# --- fingerprints -----------------------------------------------------------


def word_shingles(text: str, words: int) -> list[bytes]:
    """Lower-cased (A-Z) word n-grams, repeats included; fewer words than n: all of them as one; none: none."""
    w = text.encode("utf-8", "replace").lower().split()  # bytes.split() cuts at 20 and 09-0D, and lower() changes A-Z only
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return w if words == 1 else [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]


def simhash(features: list[bytes], seeds: tuple[int, ...] = (42,)) -> list[int]:
    """One signed 64-bit word per seed: bit j is 1 if it is set in over half of the features' XXH64."""
    out = []
    for seed in seeds:
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(features), _AT_ONCE):
            part = features[at : at + _AT_ONCE]
            h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in part), dtype="<u8", count=len(part))
            ones += np.unpackbits(h[:, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * ones > len(features), bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return out


def fingerprints(text: Column, shingle_words: int = 3, distinct: bool = False, seeds: tuple[int, ...] = (42,)) -> Column:
    """Column of array<long>, a 64-bit word per seed. ``distinct``: a shingle counts once in a text. A null text is empty."""

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got = []
            for t in texts:
                s = word_shingles(t or "", shingle_words)
                got.append(simhash(list(dict.fromkeys(s)) if distinct else s, seeds))
            yield pd.Series(got, dtype=object)

    return of(text)


# --- plan: parts and thresholds --------------------------------------------


@dataclass(frozen=True)
class Part:
    """Bits (word * 64 + bit) and the threshold of differing bits among them."""

    bits: tuple[int, ...]
    threshold: int


def plan_parts(rows: int, ones: np.ndarray, both: np.ndarray, distance: int) -> list[Part]:
    """Cheapest parts for ``distance``, by the counts of set bits (``ones``) and of pairs of set bits (``both``)."""
    n, width = max(rows, 1), len(ones)
    p = ones / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    same = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[Part]] = (math.inf, [])
    for m in range(1, min(distance + 1, width) + 1):
        parts = _grouped(corr, [width // m + (i < width % m) for i in range(m)])
        costs = [_costs(n, same[bits], distance) for bits in parts]
        # state: thresholds still to give out (each +1) -> cheapest choice so far
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in costs:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in state.items():
                for t, x in enumerate([0.0, *c], start=-1):
                    k = min(used + t + 1, distance + 1)
                    if cost + x < after.get(k, (math.inf,))[0]:
                        after[k] = (cost + x, (*chosen, t))
            state = after
        cost, chosen = state.get(distance + 1, (math.inf, ()))
        if cost < best[0]:
            best = (cost, [Part(tuple(sorted(b)), t) for b, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def _grouped(corr: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Bits in groups of the given sizes, each grown from its most correlated bit by what correlates with it most."""
    left, out = list(range(len(corr))), []
    for size in sizes:
        first = max(left, key=lambda b: (corr[b, left].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        out.append(group)
    return out


def _costs(n: int, same: np.ndarray, most: int) -> list[float]:
    """Estimated cost of thresholds 0, 1, .. of a part whose bits agree with probabilities ``same``."""
    differ = np.zeros(most + 1)
    differ[0] = 1.0
    for s in same:  # Poisson binomial of the number of differing bits
        differ[1:] = differ[1:] * s + differ[:-1] * (1 - s)
        differ[0] *= s
    out = []
    for t in range(min(most, len(same), 3) + 1):
        probes = 1 + sum(math.comb(len(same), k) for k in range(1, t + 1)) / 2
        out.append(n * probes * PROBE_COST + n * n / 2 * differ[: t + 1].sum() * PAIR_COST)
    return out


def _bit_counts(fps: DataFrame, words: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, set bits and pairs of set bits over all fingerprints: a fixed number of sums."""
    width = 64 * words

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((width, width)), 0
        for b in batches:
            for at in range(0, len(b), 8192):
                x = _bits(_words(b["fp"].iloc[at : at + 8192], words))
                both += x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"at": np.arange(width * width + 1), "n": np.append(both.ravel(), n)})

    sums = {r.at: r.n for r in fps.select("fp").mapInPandas(count, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    both = np.array([sums.get(i, 0.0) for i in range(width * width)]).reshape(width, width)
    return int(sums.get(width * width, 0)), np.diag(both).copy(), both


def _words(series: pd.Series, words: int) -> np.ndarray:
    return np.stack(series.to_numpy()).astype("<i8").view("<u8").reshape(-1, words)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little").astype(np.float32)


# --- probe and verify -------------------------------------------------------


def _probe(batches: Iterator[pd.DataFrame], parts: list[Part], words: int) -> Iterator[pd.DataFrame]:
    """For each part: the row's own key (role 0), and the keys of its neighbours (role 1).

    Of two values that differ in the bits of a mask, the one whose lowest such
    bit is 0 probes for the other, so that a pair meets once in a part.
    """
    plans = []
    for k, part in enumerate(parts):
        mask = _mask(part.bits, words)
        flips = [(_mask(c, words), min(c)) for t in range(1, part.threshold + 1) for c in combinations(part.bits, t)]
        plans.append((np.uint64(k + 1), mask, flips))
    for b in batches:
        for at in range(0, len(b), 4096):
            rows = b.iloc[at : at + 4096]
            x, node = _words(rows["fp"], words), rows["node"].to_numpy()
            keys, roles, who = [], [], []
            for salt, mask, flips in plans:
                keys.append(_key(x & mask, salt))
                roles.append(np.zeros(len(x), np.int8))
                who.append(np.arange(len(x)))
                for flip, low in flips:
                    ask = np.flatnonzero((x[:, low // 64] >> np.uint64(low % 64)) & np.uint64(1) == 0)
                    keys.append(_key((x[ask] & mask) ^ flip, salt))
                    roles.append(np.ones(len(ask), np.int8))
                    who.append(ask)
            i = np.concatenate(who)
            out = {"key": np.concatenate(keys).view("<i8"), "role": np.concatenate(roles), "node": node[i]}
            yield pd.DataFrame(out | {f"f{w}": x[i, w].view("<i8") for w in range(words)})


def _mask(bits: tuple[int, ...], words: int) -> np.ndarray:
    out = np.zeros(words, "<u8")
    for b in bits:
        out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
    return out


def _key(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Mixed part value; keys that clash only add pairs, which verification drops."""
    h = np.full(len(x), salt, "<u8") * np.uint64(0x9E3779B97F4A7C15)
    for w in range(x.shape[1]):
        h = (h ^ x[:, w]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def _match(batches: Iterator[pd.DataFrame], distance: int, words: int) -> Iterator[pd.DataFrame]:
    """Forest edges of the verified pairs within each key; rows come sorted by key and role.

    Index rows of a key are compared with all rows after them. They stay in
    memory while their key goes on; probing rows stream past.
    """
    held: pd.DataFrame | None = None
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    cols = ["key", "role", "node", *[f"f{w}" for w in range(words)]]
    for b in batches:
        if not len(b):
            continue
        old = 0
        if held is not None and len(held) and held["key"].iloc[0] == b["key"].iloc[0]:
            old, b = len(held), pd.concat([held, b[cols]], ignore_index=True)
        key, role, node = (b[c].to_numpy() for c in cols[:3])
        f = np.stack([b[c].to_numpy().view("<u8") for c in cols[3:]], axis=1)
        i, lag = np.flatnonzero(role == 0), 1
        while True:
            i = i[i < len(key) - lag]
            i = i[key[i + lag] == key[i]]
            if not len(i):
                break
            new = i if not old else i[i + lag >= old]
            ok = new[np.bitwise_count(f[new] ^ f[new + lag]).sum(axis=1) <= distance]
            if len(ok):
                found.append((node[ok], node[ok + lag]))
                waiting += len(ok)
            if waiting > 2_000_000:
                found = [_forest(found)]
                waiting = len(found[0][0])
            lag += 1
        last = (key == key[-1]) & (role == 0)
        held = b.loc[last, cols].reset_index(drop=True)
        if waiting > 500_000:
            yield _as_edges(_forest(found))
            found, waiting = [], 0
    if waiting:
        yield _as_edges(_forest(found))


def _as_edges(pairs: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def _forest(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, smallest node of its component) that connect what the pairs connect."""
    nodes, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*found, strict=True)]), return_inverse=True)
    a, b = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    kept = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[kept], nodes[label[kept]]


def near_pairs(fps: DataFrame, distance: int, words: int = 1, partitions: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the nodes of ``fps`` connected by links of at most ``distance`` bits.

    ``fps``: a written table of ``node`` (long) and ``fp`` (array<long>), one row per different fingerprint.
    """
    spark = fps.sparkSession
    parts = plan_parts(*_bit_counts(fps, words), distance)
    schema = "key long, role byte, node long, " + ", ".join(f"f{w} long" for w in range(words))
    probes = fps.select("node", "fp").mapInPandas(partial(_probe, parts=parts, words=words), schema)
    own = fps.select("node", "fp").mapInPandas(
        partial(_probe, parts=[Part(p.bits, 0) for p in parts], words=words), schema
    )
    hot = written(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS))
    if not hot.isEmpty():
        probes = _dealt(probes, hot)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        probes.repartition(n, "key")
        .sortWithinPartitions("key", "role")
        .mapInPandas(partial(_match, distance=distance, words=words), "a long, b long")
    )


def _dealt(probes: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot keys in blocks: an index row stays in its block and probes the later ones, a probe goes to all."""
    rows = probes.join(small(hot), "key", "left")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    to = F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(
        F.sequence(F.when(F.col("role") == 0, mine).otherwise(F.lit(0)), blocks - 1)
    )
    spread = rows.withColumn("mine", F.when(F.col("role") == 0, mine)).withColumn("to", F.explode(to))
    role = F.when((F.col("to") < 0) | F.col("mine").eqNullSafe(F.col("to")), F.col("role")).otherwise(F.lit(1))
    return spread.select(
        F.when(F.col("to") < 0, F.col("key")).otherwise(F.xxhash64("key", "to")).alias("key"),
        role.cast("byte").alias("role"),
        *[c for c in probes.columns if c not in ("key", "role")],
    )


# --- operators --------------------------------------------------------------


def near_duplicate_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle_words: int = 3,
    distinct: bool = False,
    seeds: tuple[int, ...] = (42,),
    distance: int = 3,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    Fingerprints of ``distance`` or fewer differing bits link; ``component_id``
    is the smallest id reachable by links, itself included. A text without
    words, or a null one, has the fingerprint zero and links like any other.
    Rows that repeat an id are documents of their own, so an id may have rows
    of different components. A row with a null id links with nothing and
    has a null component. An empty table gives an empty table.

    The work is on different fingerprints: however many documents share one, it
    is one node. What comes back to the documents are the fingerprints that
    have company.
    """
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            fingerprints(F.col(text_col), shingle_words, distinct, seeds).alias("fp"),
        )
    )
    nodes = written(
        rows.where("doc_id IS NOT NULL")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    edges = written(near_pairs(nodes, distance, len(seeds)).where("a <> b").distinct())
    smallest = smallest_of_components(edges, nodes.select("node", "first"))
    company = written(
        nodes.join(small(smallest), "node", "left")
        .where("n > 1 OR smallest IS NOT NULL")
        .select("fp", F.coalesce("smallest", "first").alias("component_id"))
    )
    out = rows.join(small(company), "fp", "left")
    return out.select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def fingerprint_hex(fp: Column) -> Column:
    """16 lower-case hex digits of each 64-bit word of a fingerprint."""
    return F.array_join(F.transform(fp, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def leader_similarity(text: Column, leader: Column, words: int = 5) -> Column:
    """Jaccard similarity of the sets of word shingles of two texts; of two without words it is 1."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last: tuple[str | None, set[bytes]] = (None, set())
        for texts, leaders in batches:
            got = []
            for t, lead in zip(texts, leaders, strict=True):
                if lead != last[0]:
                    last = (lead, set(word_shingles(lead or "", words)))
                a, b = set(word_shingles(t or "", words)), last[1]
                got.append(len(a & b) / len(a | b) if a or b else 1.0)
            yield pd.Series(got, dtype="float64")

    return of(text, leader)


#: SimHash of a text's different words: 128 bits, and how many may differ. Scattered edits at five-word similarity 0.8 change about 9.
NEAR_SEEDS, NEAR_BITS = (42, 43), 14
#: MinHash bands of a shingle set, and hashes in each: a pair of Jaccard similarity J shares no band with probability
#: (1 - J^5)^40, which is 1.3e-7 at 0.8 and less above, wherever the edits are.
NEAR_BANDS, NEAR_ROWS = 40, 5
#: Documents on either side of a block of exact comparisons.
PAIR_BLOCK = 64


def band_keys(shingles: list[bytes], bands: int = NEAR_BANDS, rows: int = NEAR_ROWS) -> np.ndarray:
    """A signed 64-bit key per band, of the least values of the shingles' XXH64 under ``rows`` hash functions. No shingles: those of an empty one."""
    rng = np.random.default_rng(9)
    times, plus = (rng.integers(0, 1 << 64, (bands * rows, 1), dtype="<u8") for _ in range(2))
    times |= np.uint64(1)
    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles or [b""]), dtype="<u8")
    least = np.full(bands * rows, np.iinfo("<u8").max, "<u8")
    for at in range(0, len(h), 1024):
        x = h[at : at + 1024] * times + plus
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(axis=1), out=least)
    key = np.arange(1, bands + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)
    for x in least.reshape(bands, rows).T:
        key = (key ^ x) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view("<i8")


def near_candidates(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Edges ``(a, b)`` of ids that share a MinHash band: near copies that no fingerprint can tell, as those of edits in one block.

    An id is linked to the smallest of each of its bands, so a band of very
    many documents makes no more edges than it has documents.
    """

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([band_keys(list(set(word_shingles(t or "", words)))) for t in texts], dtype=object)

    signed = written(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), keys(F.col(text_col)).alias("keys")))
    rows = signed.select("doc_id", F.explode("keys").alias("key"))
    shared = written(rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("key", "a"))
    return rows.join(small(shared), "key").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()


def near_duplicate_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = 5,
    similarity: float = 0.8,
    seeds: tuple[int, ...] = NEAR_SEEDS,
    distance: int = NEAR_BITS,
) -> DataFrame:
    """Edges ``(a, b)`` of ids that connect documents whose shingle sets have at least the Jaccard ``similarity``.

    SimHash proposes: documents whose fingerprints of different words differ in
    at most ``distance`` bits, all of them, by the search over parts and
    thresholds. Edits in one block bring many new words and change more bits,
    so MinHash bands of the shingle sets propose as well: whether a pair shares
    one depends on its similarity alone. Components are of both kinds of links.
    Shingles decide, by exact similarity: every document of a component is
    first compared with its pivot, whose fingerprint is nearest to the majority
    of the component's. Copies of one text are
    nearest to it, so few are left. Those are compared in blocks with all
    documents of their component that aren't connected with them yet. Only a
    spanning forest leaves a block.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    printed = written(
        near_duplicate_components(docs, id_col, text_col, shingle_words=1, distinct=True, seeds=seeds, distance=distance)
    )
    near = printed.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    linked = connected_components(near.unionByName(near_candidates(docs, id_col, text_col, words).select("a", "b")))
    comps = written(linked.select(F.col("node").alias("doc_id"), F.col("component").alias("c")))
    told = written(text.join(small(comps), "doc_id").dropDuplicates(["doc_id"]))
    members = printed.select("doc_id", "fp").join(small(comps), "doc_id").dropDuplicates(["doc_id"])
    members = written(members.select("doc_id", "c", *[F.get("fp", F.lit(w)).alias(f"f{w}") for w in range(len(seeds))]))

    bits = [(w, b) for w in range(len(seeds)) for b in range(64)]
    ones = members.groupBy("c").agg(
        F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned(f"f{w}", b).bitwiseAND(F.lit(1))).alias(f"b{w}_{b}") for w, b in bits]
    )
    most = [
        _sum([F.when(F.col(f"b{w}_{b}") * 2 > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)])
        for w in range(len(seeds))
    ]
    centre = written(ones.select("c", *[m.alias(f"m{w}") for w, m in enumerate(most)]))
    off = _sum([F.bit_count(F.col(f"f{w}").bitwiseXOR(F.col(f"m{w}"))) for w in range(len(seeds))])
    pivots = written(
        members.join(small(centre), "c").groupBy("c").agg(F.min(F.struct(off.alias("off"), "doc_id")).alias("p")).select("c", F.col("p.doc_id").alias("pivot"))
    )
    texts = written(told.join(small(pivots), "c"))
    lead = written(texts.where("doc_id = pivot").select("pivot", F.col("text").alias("lead")))
    judged = written(
        texts.where("doc_id <> pivot")
        .join(lead, "pivot")
        .select("doc_id", "c", "pivot", leader_similarity(F.col("text"), F.col("lead"), words).alias("near"))
    )
    direct = judged.where(F.col("near") >= similarity).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    left = written(judged.where(F.col("near") < similarity).select("doc_id", "c"))

    sizes = left.groupBy("c").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("ga"))
    sizes = sizes.join(members.groupBy("c").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("gb")), "c")
    sizes = small(written(sizes))
    place = lambda salt, groups: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(groups)).cast("int")
    every = lambda groups: F.explode(F.sequence(F.lit(0), F.col(groups) - 1))
    known = texts.select("doc_id", "c", "text", "pivot").join(small(direct.select(F.col("a").alias("doc_id"), F.lit(True).alias("met"))), "doc_id", "left")
    group = F.when(F.col("met") | (F.col("doc_id") == F.col("pivot")), F.col("pivot")).otherwise(F.col("doc_id"))
    known = known.select("doc_id", "c", "text", group.alias("of")).join(sizes, "c")
    asking = known.where("of = doc_id").join(small(left.select("doc_id")), "doc_id", "left_semi").select(
        "doc_id", "c", "text", "of", F.lit(True).alias("asks"), place("a", "ga").alias("ka"), every("gb").alias("kb")
    )
    asked = known.select("doc_id", "c", "text", "of", F.lit(False).alias("asks"), every("ga").alias("ka"), place("b", "gb").alias("kb"))
    blocks = asking.unionByName(asked).groupBy("c", "ka", "kb")
    rest = blocks.applyInPandas(lambda rows: _block_links(rows, words, similarity), "a long, b long")
    return direct.unionByName(rest)


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _block_links(rows: pd.DataFrame, words: int, similarity: float) -> pd.DataFrame:
    """Edges from the asking documents of a block to others of it that connect all similar ones; ``of`` groups are connected already."""
    sets = [set(word_shingles(t or "", words)) for t in rows["text"]]
    ids, of = rows["doc_id"].tolist(), rows["of"].tolist()
    parent = {g: g for g in of}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    asks = np.flatnonzero(rows["asks"].to_numpy())
    others = np.flatnonzero(~rows["asks"].to_numpy())
    out = []
    for i in asks:
        for j in others:
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) < similarity * max(a, b) or root(of[i]) == root(of[j]):
                continue
            both = len(sets[i] & sets[j])
            if (both >= similarity * (a + b - both)) if a or b else True:
                out.append((ids[i], ids[j]))
                parent[root(of[i])] = root(of[j])
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document, of the smallest id, of each group that ``near_duplicate_links`` connects.

    Rows with a null id stay. Rows that repeat an id count as one document, of
    either text, and stay or go together. Texts without words are equal. An
    empty table gives an empty table. Options: see ``near_duplicate_links``.
    """
    edges = written(near_duplicate_links(docs, id_col, text_col, **options))
    gone = written(connected_components(edges).where("node <> component").select(F.col("node").alias("_tw9_gone")))
    return docs.join(small(gone), F.col(id_col).cast("long") == F.col("_tw9_gone"), "left_anti")
