import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import tidewake.llm.simhash as sh
from tidewake.llm.simhash import drop_near_duplicates, fingerprint_hex, near_duplicate_components, plan_parts


def plain_fingerprint(text):
    words, now = [], []
    for c in (text or ""):
        if c in " \t\n\x0b\x0c\r":
            words, now = words + ["".join(now)] * bool(now), []
        else:
            now.append(c.lower() if "A" <= c <= "Z" else c)
    words += ["".join(now)] * bool(now)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components(ids, fps, distance):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, fps, strict=True):
        for j, b in zip(ids, fps, strict=True):
            if i < j and (a ^ b).bit_count() <= distance:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def texts():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(40)]
    out = list(base)
    for t in base[:15]:
        w = t.split()
        w[3] = "changed"
        out += [" ".join(w), t.upper(), t + " more", t.replace(" ", "\t\n")]
    return [*out, None, "", "  \n", "one", "One", "two words", "É é x y", "z " * 5000]


def test_fingerprints_and_components_match_brute_force(spark):
    rows = list(enumerate(texts(), start=10))
    docs = spark.createDataFrame([*rows, (None, "one")], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = near_duplicate_components(docs).select("doc_id", fingerprint_hex(F.col("fp")).alias("h"), "component_id").collect()
    want = {i: plain_fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.h for r in got if r.doc_id is not None} == {i: f"{f:016x}" for i, f in want.items()}
    assert {r.doc_id: r.component_id for r in got} == components(list(want), list(want.values()), 3) | {None: None}


@pytest.mark.parametrize("probe_cost,block", [(1e-6, 16_384), (2.0, 7)])
def test_other_plans_and_dealt_hot_keys_lose_no_link(spark, monkeypatch, probe_cost, block):
    monkeypatch.setattr(sh, "PROBE_COST", probe_cost)
    monkeypatch.setattr(sh, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    fps = [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))] + [int(x) for x in rng.integers(0, 1 << 62, 200)]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(i, [f]) for i, f in enumerate(fps)], "node long, fp array<long>")
    edges = sh.near_pairs(nodes, 3).collect()
    assert all((fps[e.a] ^ fps[e.b]).bit_count() >= 0 for e in edges)
    parent = {i: i for i in range(len(fps))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        x, y = root(e.a), root(e.b)
        parent[max(x, y)] = min(x, y)
    assert {i: root(i) for i in parent} == components(list(parent), fps, 3)


def test_plan_covers_the_distance():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    x[:, 5] = x[:, 40]
    for distance in (3, 7):
        parts = plan_parts(10**7, x.sum(axis=0) * 20_000, x.T @ x * 20_000, distance)
        assert sum(p.threshold + 1 for p in parts) >= distance + 1
        bits = [b for p in parts for b in p.bits]
        assert len(bits) == len(set(bits))
        assert {5, 40} <= set(next(p.bits for p in parts if 5 in p.bits)) or len(parts) > 8


def test_near_duplicates_go_and_others_stay(spark):
    rng = np.random.default_rng(5)
    words = [f"v{k}" for k in range(3000)]
    rows, groups = [], []
    for g in range(30):
        w = list(rng.choice(words, 200))
        ids = []
        for c in range(5 if g < 12 else 1):
            v = list(w)
            for p in rng.choice(200, 2 if c else 0, replace=False):
                v[p] = "edit"
            ids.append(1000 - len(rows))
            rows.append((ids[-1], " ".join(v), g))
        groups.append(ids)
    rows += [(-1, "short text", 0), (-2, "text short", 0), (None, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c int")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {min(g) for g in groups} | {-1, -2, None}


@pytest.mark.parametrize("kind", ["appended", "truncated", "block", "scattered"])
def test_near_copies_of_every_kind_go_as_by_brute_force(spark, kind):
    rng = np.random.default_rng(6)
    words = [f"v{k}" for k in range(5000)]
    texts, near = [], 0
    for _ in range(150):
        w = list(rng.choice(words, int(rng.integers(60, 600))))
        n, new = len(w), [str(x) for x in rng.integers(10**9, size=600)]
        k = max(1, int(n * rng.uniform(0.05, 0.19)))
        at = int(rng.integers(0, n - k))
        v = {"appended": w + new[:k], "truncated": w[:-k], "block": w[:at] + new[: k // 2] + w[at + k // 2 :]}.get(kind, list(w))
        if kind == "scattered":
            for p in rng.choice(n, max(1, k // 9), replace=False):
                v[p] = new[p]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        near += len(a & b) >= 0.8 * len(a | b)
        texts.append((" ".join(w), " ".join(v), len(a & b) >= 0.8 * len(a | b)))
    assert near > 80
    rows = [(2 * i + c, t[c]) for i, t in enumerate(texts) for c in (0, 1)]
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(150)} | {2 * i + 1 for i, t in enumerate(texts) if not t[2]}


def test_the_pipeline_links_by_simhash_and_checks(spark, monkeypatch):
    import corpus_pipeline

    nothing = spark.createDataFrame([], "a long, b long, node long, component long")
    monkeypatch.setattr(sh, "near_candidates", lambda *a, **b: nothing)  # no MinHash bands
    rng = np.random.default_rng(8)
    words = [f"v{k}" for k in range(4000)]
    rows, kept = [], set()
    for g in range(40):
        w = [str(x) for x in rng.choice(words, 300, replace=False)]
        copy = list(w)
        for p in (20, 150, 280):
            copy[p] = f"edit{p}"
        turned = [x for k in range(0, 300, 3) for x in reversed(w[k : k + 3])]  # the same words: no bit differs, but no shingle is shared
        rows += [(10 * g, " ".join(w)), (10 * g + 1, " ".join(copy)), (10 * g + 2, " ".join(turned))]
        kept |= {10 * g, 10 * g + 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept


def test_blocks_find_what_the_pivot_misses():
    import pandas as pd

    a = [f"x{k}" for k in range(60)]
    chain = [a, a[:30] + ["e"] + a[31:], a[:30] + ["e"] + a[31:50] + ["f"] + a[51:]]
    rows = pd.DataFrame(
        [(k, " ".join(chain[k]), k, asks) for k in range(3) for asks in (True, False)], columns=["doc_id", "text", "of", "asks"]
    )
    edges = {tuple(sorted(e)) for e in sh._block_links(rows, 5, 0.8).itertuples(index=False)}
    assert edges == {(0, 1), (1, 2)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_components(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0
