import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidewake.llm.mixing as mx
from tidewake.llm.mixing import draws, mix, split_quotas, targets


def fill_by_hand(sizes):
    """Targets by bisection on the level of the weights."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(3 * sizes[s], level * weight[s]) for s in names) < total:
            low = level
        else:
            high = level
    return {s: min(3 * sizes[s], low * weight[s]) for s in names}


def test_targets_are_capped_and_the_excess_reshared():
    for sizes in ({"b": 10, "a": 1000, None: 3, "": 40, "c": 500}, {"x": 7}, {"x": 0, "y": 5}):
        got = targets(list(sizes.items()))
        want = fill_by_hand(sizes)
        assert all(abs(got[s] - want[s]) < 1e-3 for s in sizes)
    assert targets([("a", 0), ("b", 0)]) == {"a": 0.0, "b": 0.0}


def test_tree_splits_quotas_exactly():
    quotas = np.array([0, 7, 1000, 33])
    out = split_quotas(quotas, 13, 1)
    assert (out.sum(axis=0) == quotas).all()
    assert np.ptp(out.sum(axis=1)) <= 1


ROWS = [(i, " ".join(["w"] * (i % 37 + 1)), "ab"[i % 2]) for i in range(400)]
ROWS += [(1000, "x\ty z\n" * 2000, "big"), (1001, None, "a"), (1002, "", None), (1003, "q r", None), (None, "n n n", "a"), (5, " ".join(["w"] * 6), "b"), (5, " ".join(["w"] * 6), "b")]


def test_draws_meet_targets_and_repeat(spark, monkeypatch):
    monkeypatch.setattr(mx, "PER_BLOCK", 8)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("words", F.lit(1))
    got = draws(docs, shards=5).collect()
    sizes, taken = {}, {}
    for r in got:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        words = sum(d.words for d in r.mix_draws)
        assert words <= 3 * r.mix_size
        taken[r.source] = taken.get(r.source, 0) + words
    want = fill_by_hand(sizes)
    for r in got:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) < 1e-3
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])
    again = draws(docs.repartition(7), shards=5).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


@pytest.mark.parametrize("task_words", [mx.TASK_WORDS, 300])
def test_mixture_holds_the_drawn_words(spark, monkeypatch, task_words):
    monkeypatch.setattr(mx, "TASK_WORDS", task_words)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    mixed = mix(docs, shards=5)
    assert (mixed.rdd.getNumPartitions() == 5) == (task_words == mx.TASK_WORDS == 10_000_000)
    out = mixed.collect()
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.mix_words for r in out)
    whole = {(i, t) for i, t, _ in ROWS}
    cut = [r for r in out if (r.doc_id, r.text) not in whole]
    assert all(any(t.startswith(r.text) for i, t in whole if i == r.doc_id) for r in cut) and len(cut) <= 4
    assert {r.mix_shard for r in out} <= set(range(5))


def test_a_large_partly_taken_block_is_divided(spark, monkeypatch):
    monkeypatch.setattr(mx, "MOST_BLOCKS", 3)
    monkeypatch.setattr(mx, "FILL_ROWS", 5)
    rows = [(i if i % 3 else None, f"{i} " * (i % 11 + 1), "abc"[i % 3]) for i in range(900)]
    seen = []
    fill = mx._fill
    monkeypatch.setattr(mx, "_blocks", lambda spark, sources, divided, seed, of=mx._blocks: seen.append(max(map(len, divided.values()))) or of(spark, sources, divided, seed))
    got = draws(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4).collect()
    assert seen[-1] >= 2 and fill is mx._fill
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + sum(d.words for d in r.mix_draws)
        assert {d.words for d in r.mix_draws} <= {r.mix_size} or sum(d.words != r.mix_size for d in r.mix_draws) == 1
    want = {r.source: r.mix_target for r in got}
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 for s in want)


def test_rows_without_an_id_are_in_blocks_of_their_own(spark):
    rows = [(None, f"text {i} " * 5, "a") for i in range(600)] + [(None, "more words", "b")] * 3
    got = draws(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4).collect()
    shards = {d.shard for r in got for d in r.mix_draws if r.source == "a"}
    assert len(shards) == 4 and len({repr(r.mix_draws) for r in got if r.source == "b"}) == 1


def test_columns_of_any_name_stay(spark):
    names = ["mix_weight", "mix_size", "mix_draw", "mix_place", "mix_part", "row", "draw", "place", "part", "key", "block", "divided", "units", "a.b"]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").select("*", *[F.lit(n).alias(n) for n in names])
    out = mix(docs, shards=3).collect()
    assert out and all(r.asDict()[n] == n for r in out[:50] for n in names)
    drawn = draws(docs, shards=3).collect()
    assert all(r.asDict()[n] == n for r in drawn[:50] for n in names if n != "mix_size") and isinstance(drawn[0].mix_size, int)


def test_empty_table(spark):
    assert draws(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
