import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewake.operators import facts as st

T0 = datetime(2024, 1, 1)


class Store:
    """A small fact log: one transaction per remembered fact."""

    def __init__(self):
        self.facts, self.tx, self.parents, self.prov = [], [], [], []

    def add(self, tx, name, op="assert", branch="main", parents=(), supersedes=None, archived=False, entity="e", attribute="a"):
        self.tx.append((tx, branch, T0 + timedelta(hours=tx), archived))
        self.parents += [(tx, p) for p in parents]
        if name:
            self.facts.append((f"{name}:{op}", entity, attribute, name, op, tx, False))
            if supersedes:
                self.prov.append((f"{name}:{op}", f"{supersedes}:assert", "supersedes", tx))
        return self

    def frames(self, spark):
        return (
            spark.createDataFrame(self.facts, "id string, entity_id string, attribute string, value string, op string, tx_id long, redacted boolean"),
            spark.createDataFrame(self.tx, "id long, branch_id string, ts timestamp, archived boolean"),
            spark.createDataFrame(self.parents, "tx_id long, parent_tx_id long"),
            spark.createDataFrame(self.prov, "fact_id string, source_fact_id string, kind string, tx_id long"),
        )


def ids(df):
    return {r.id for r in df.collect()}


def test_current_leaves_out_what_was_retracted(spark):
    f, t, _, p = Store().add(1, "kept").add(2, "dropped").add(3, "dropped", "retract").frames(spark)
    seen = st.visible(f, t, p, t.select("id"))
    assert seen.count() == 3
    assert ids(st.current(seen)) == ids(st.not_shadowed(seen)) == {"kept:assert"}


def test_as_of_follows_the_parents(spark):
    f, t, parents, p = Store().add(1, "first").add(2, "second", parents=[1]).add(3, "third", parents=[2]).frames(spark)
    at = lambda tx: ids(st.visible(f, t, p, st.ancestors(parents, t.where(F.col("id") == tx).select("id"))))
    assert at(2) == {"first:assert", "second:assert"} and at(1) == {"first:assert"}


def test_merge_is_seen_through_its_transaction_only(spark):
    s = Store().add(1, "base").add(2, "side", branch="b", parents=[1]).add(3, "main2", parents=[1]).add(4, None, parents=[3, 2])
    f, t, parents, p = s.frames(spark)
    assert ids(st.visible(f, t, p, st.branch_scope(t, "main"))) == {"base:assert", "main2:assert"}
    merged = st.ancestors(parents, t.where("id = 4").select("id"))
    assert ids(st.visible(f, t, p, merged)) == {"base:assert", "side:assert", "main2:assert"}


def test_superseded_also_where_the_replacement_began_in_an_archived_transaction(spark):
    s = Store().add(1, "old").add(2, "new", archived=True)
    s.prov.append(("new:assert", "old:assert", "supersedes", 3))
    s.tx.append((3, "main", T0 + timedelta(hours=3), False))
    f, t, _, p = s.frames(spark)
    scope = st.branch_scope(t, "main")
    assert ids(st.superseded(f, t, p, scope)) == {"old:assert"}
    assert ids(st.visible(f, t, p, scope)) == {"old:assert", "new:assert"}  # seen by its edge
    steps = st.trace(p, t, f.where("id = 'new:assert'").select("id"))
    assert {(r.id, r.depth) for r in steps.collect()} == {("new:assert", 0), ("old:assert", 1)}


def test_first_write_wins(spark):
    f, *_ = Store().add(1, "x").frames(spark)
    new = spark.createDataFrame(
        [("x:assert", "e", "a", "x", "assert", 9, False, T0), ("y:assert", "e", "a", "y", "assert", 8, False, T0 + timedelta(hours=1)), ("y:assert", "e", "a", "y", "assert", 9, False, T0)],
        "id string, entity_id string, attribute string, value string, op string, tx_id long, redacted boolean, ts timestamp",
    )
    assert {(r.id, r.tx_id) for r in st.remember(f, new).collect()} == {("x:assert", 1), ("y:assert", 9)}


def test_gc_protects_main_and_takes_stale_and_abandoned(spark):
    _, t, _, _ = Store().add(1, "a").add(50, "b", branch="live").add(2, "c", branch="stale").add(60, "d", branch="gone").frames(spark)
    branches = spark.createDataFrame(
        [("main", "main", 1, "active", T0), ("live", "live", 50, "active", T0), ("stale", "stale", 2, "active", T0), ("gone", "gone", 60, "abandoned", T0), ("new", "new", None, "active", T0 + timedelta(hours=90))],
        "id string, name string, head_tx_id long, state string, created_at timestamp",
    )
    out = {r.id: (r.archived_now, r.n_open) for r in st.stale_branches(branches, t, F.lit(T0 + timedelta(hours=10))).collect()}
    assert out == {"main": (False, 0), "live": (False, 0), "stale": (True, 1), "gone": (True, 1), "new": (False, 0)}


def test_profile_and_reflection(spark):
    s = Store()
    for k in range(4):
        s.add(k, f"v{k}", attribute=("code", "note", "reflection", "note")[k])
    s.add(9, "lone", entity="other")
    f, t, _, p = s.frames(spark)
    now = st.current(st.visible(f, t, p, t.select("id")))
    known = spark.createDataFrame([("code", True)], "name string, is_code_relation boolean")
    got = {(r.entity_id, r.bucket, r.id) for r in st.profile(now, known, 1).collect()}
    assert got == {("e", "static", "v0:assert"), ("e", "dynamic", "v3:assert"), ("e", "summary", "v2:assert"), ("other", "dynamic", "lone:assert")}
    old = st.reflection_candidates(now, F.lit(T0 + timedelta(days=5)), most=3).collect()
    assert {(r.id, r.total) for r in old} == {("v0:assert", 4), ("v1:assert", 4), ("v2:assert", 4)}
    audited = spark.createDataFrame([("none",)], "summary_fact_id string")
    assert ids(st.orphan_reflections(f, audited)) == {"v2:assert"}


def test_ancestors_match_a_plain_walk_over_merges(spark):
    r = random.Random(3)
    edges = [(i, i - 1) for i in range(1, 60)] + [(i, r.randrange(i)) for i in range(5, 60, 4)] + [(70, 69), (5, None)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).update({b} - {None})
    parents = spark.createDataFrame(edges, "tx_id long, parent_tx_id long")
    for starts in ([59], [0], [70, 7], [999]):
        want, todo = set(), list(starts)
        while todo:
            x = todo.pop()
            if x not in want:
                want.add(x)
                todo += up.get(x, ())
        got = st.ancestors(parents, spark.createDataFrame([(s,) for s in starts], "id long")).collect()
        assert sorted(x.id for x in got) == sorted(want)
    assert st.ancestors(parents.limit(0), spark.createDataFrame([(4,), (4,)], "id long")).collect() == [(4,)]


def test_null_fields_have_ids_of_their_own_and_repeated_facts_keep_one_whole_row(spark):
    rows = spark.createDataFrame([("a", None, "b", "x"), ("a", "b", None, "x"), ("a", "b", "x", None)], "e string, a string, v string, o string")
    assert rows.select(st.fact_id(F.col("e"), F.col("a"), F.col("v"), F.col("o")).alias("i")).distinct().count() == 3
    schema = "id string, entity_id string, attribute string, value string, op string, tx_id long, redacted boolean"
    new = spark.createDataFrame([("f", "e", "a", "v", "assert", 2, True, 5), ("f", "e", "a", "v", "assert", 1, False, 5)], schema + ", ts long")
    kept = st.remember(spark.createDataFrame([], schema), new.repartition(3)).collect()
    assert [(k.tx_id, k.redacted) for k in kept] == [(1, False)]


def test_fork_merge_and_restore_change_nothing_where_they_do_not_apply(spark):
    tx = spark.createDataFrame([(1, "m", 1, False), (2, "x", 2, True)], "id long, branch_id string, ts long, archived boolean")
    br = spark.createDataFrame([("m", "main", 1, "active", 1), ("x", "x", 2, "abandoned", 2)], "id string, name string, head_tx_id long, state string, created_at long")
    up = spark.createDataFrame([], "tx_id long, parent_tx_id long")
    for graph in (st.fork(tx, br, up, "x", "m", 9, F.lit(9).cast("long")), st.fork(tx, br, up, "y", "x", 9, F.lit(9).cast("long")), st.merge(tx, br, up, "x", "m", 9, F.lit(9).cast("long"))):
        assert [g.count() for g in graph] == [2, 2, 0] and {r.state for r in graph[1].collect()} == {"active", "abandoned"}
    branches, rows = st.restore(br, tx, "x")
    assert {r.state for r in branches.collect()} == {"active"} and not any(r.archived for r in rows.collect())
    branches, rows = st.restore(br, tx, "m")
    assert sorted(r.archived for r in rows.collect()) == [False, True]
