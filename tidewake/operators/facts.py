"""Temporal fact store: append-only facts on a transaction graph, seen through scopes.

Tables: ``facts`` (id, entity_id, attribute, value, op, tx_id, redacted),
``transactions`` (id, branch_id, ts, archived), ``parents`` (tx_id,
parent_tx_id), ``provenance`` (fact_id, source_fact_id, kind, tx_id), where
``fact_id`` is the newer fact. A scope is a table of transaction ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import if_small, stored

#: Rows of a recall by default and at most; depth of a trace by default and at most.
RECALL, TRACE = (20, 100), (5, 20)
#: Least facts of an entity that is reflected on, and most that are read.
REFLECT_LEAST, REFLECT_MOST = 2, 50


def fact_id(entity: Column, attribute: Column, value: Column, op: Column) -> Column:
    """Content hash of a fact; fields are set apart by a unit separator, and a null field is a marker of its own."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00null")) for c in (entity, attribute, value, op)]), 256)


def remember(facts: DataFrame, new: DataFrame) -> DataFrame:
    """``facts`` with those of ``new`` whose ids aren't there yet; of equal ids the whole row that is first by (ts, tx_id) stays."""
    rest = ["entity_id", "attribute", "value", "op", "redacted"]
    first = new.groupBy("id").agg(F.min(F.struct("ts", "tx_id", *rest)).alias("f"))
    rows = first.select("id", *[F.col(f"f.{c}").alias(c) for c in ("entity_id", "attribute", "value", "op", "tx_id", "redacted")])
    return facts.unionByName(rows.join(facts.select("id"), "id", "left_anti"))


def rejected(new: DataFrame, provenance: DataFrame) -> DataFrame:
    """``(id, reason)`` of facts of ``new`` that may not be remembered.

    ``provenance`` has the edges that come with them (fact_id, source_fact_id,
    kind). A fact may neither supersede itself nor have one source both as
    evidence and as superseded, and needs an entity, an attribute and an op
    that is assert or retract.
    """
    named = F.col("entity_id").isNotNull() & (F.trim("entity_id") != "") & F.col("attribute").isNotNull() & (F.trim("attribute") != "")
    reason = F.when(~F.coalesce(named, F.lit(False)), "unnamed").when(~F.coalesce(F.col("op").isin("assert", "retract"), F.lit(False)), "unknown op")
    bad = new.select("id", reason.alias("reason")).where("reason IS NOT NULL")
    own = provenance.join(new.select(F.col("id").alias("fact_id")).distinct(), "fact_id", "left_semi")
    itself = own.where("fact_id = source_fact_id AND kind = 'supersedes'").select(F.col("fact_id").alias("id"), F.lit("supersedes itself").alias("reason"))
    kinds = own.groupBy("fact_id", "source_fact_id").agg(F.countDistinct("kind").alias("n")).where("n > 1")
    twice = kinds.select(F.col("fact_id").alias("id"), F.lit("evidence that it supersedes").alias("reason"))
    return bad.unionByName(itself).unionByName(twice).distinct()


def retract(now: DataFrame, wanted: DataFrame) -> DataFrame:
    """Retracting facts (id, entity_id, attribute, value, op) for current ones (entity_id, attribute, value) that ``wanted`` names."""
    key = ["entity_id", "attribute", "value"]
    held = now.join(wanted.select(*key).distinct(), key, "left_semi").select(*key).distinct().withColumn("op", F.lit("retract"))
    return held.select(fact_id(*[F.col(c) for c in (*key, "op")]).alias("id"), *key, "op")


def fork(transactions: DataFrame, branches: DataFrame, parents: DataFrame, name: str, source: str, tx_id: int, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions, branches and parents with a branch ``name`` whose first transaction ``tx_id`` has the source's head as parent.

    Nothing changes if the source has no row or the name is taken.
    """
    source_row = branches.where((F.col("id") == source) & (F.col("state") == "active")).join(branches.where(F.col("id") == name), F.lit(True), "left_anti")
    new = source_row.select(F.lit(tx_id).cast("long").alias("tx_id"), F.col("head_tx_id").alias("parent_tx_id"), at.alias("ts"))
    tx = new.select(F.col("tx_id").alias("id"), F.lit(name).alias("branch_id"), "ts", F.lit(False).alias("archived"))
    branch = new.select(F.lit(name).alias("id"), F.lit(name).alias("name"), F.col("tx_id").alias("head_tx_id"), F.lit("active").alias("state"), F.col("ts").alias("created_at"))
    return transactions.unionByName(tx), branches.unionByName(branch), parents.unionByName(new.select("tx_id", "parent_tx_id"))


def merge(transactions: DataFrame, branches: DataFrame, parents: DataFrame, source: str, target: str, tx_id: int, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions, branches and parents after a transaction on ``target`` that has both heads as parents; ``source`` is then merged.

    No fact is copied: what the source's facts are seen by is reachability.
    """
    heads = branches.where(F.col("id").isin(source, target) & (F.col("state") == "active"))
    both = heads.agg(F.count_distinct("id").alias("n")).where("n = 2").select(F.lit(tx_id).cast("long").alias("tx_id"), at.alias("ts"))
    tx = both.select(F.col("tx_id").alias("id"), F.lit(target).alias("branch_id"), "ts", F.lit(False).alias("archived"))
    up = heads.crossJoin(F.broadcast(both)).select("tx_id", F.col("head_tx_id").alias("parent_tx_id"))  # one row
    done = branches.crossJoin(F.broadcast(heads.agg((F.count_distinct("id") == 2).alias("ok"))))  # one row
    state = F.when(F.col("ok") & (F.col("id") == source), "merged").otherwise(F.col("state"))
    head = F.when(F.col("ok") & (F.col("id") == target), F.lit(tx_id).cast("long")).otherwise(F.col("head_tx_id"))
    changed = done.select("id", "name", head.alias("head_tx_id"), state.alias("state"), "created_at")
    return transactions.unionByName(tx), changed, parents.unionByName(up)


def restore(branches: DataFrame, transactions: DataFrame, branch: str) -> tuple[DataFrame, DataFrame]:
    """Branches and transactions with an abandoned branch active again and its transactions no longer archived."""
    back = branches.where((F.col("id") == branch) & (F.col("state") == "abandoned")).select(F.col("id").alias("branch_id"), F.lit(True).alias("back"))
    state = F.when((F.col("id") == branch) & (F.col("state") == "abandoned"), "active").otherwise(F.col("state"))
    rows = transactions.join(F.broadcast(back), "branch_id", "left")  # one row
    archived = F.col("archived") & ~F.coalesce("back", F.lit(False))
    return branches.withColumn("state", state), rows.withColumn("archived", archived).select(*transactions.columns)


def semantic_recall(seen: DataFrame, scores: DataFrame, k: int = RECALL[0]) -> DataFrame:
    """``(id, score, rank)``: of facts not shadowed in a scope those of the best ``scores`` (id, score); ties go to the later, then smaller id."""
    held = not_shadowed(seen).select("id", "own_ts").join(scores.select("id", "score"), "id")
    best = held.orderBy(F.desc("score"), F.desc("own_ts"), "id").limit(min(max(k, 1), RECALL[1]))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("own_ts"), "id"))).select("id", "score", "rank")  # 100 rows at most


def branch_scope(transactions: DataFrame, branch: str) -> DataFrame:
    return transactions.where((F.col("branch_id") == branch) & ~F.col("archived")).select("id")


def ancestors(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """Transactions (id) reachable from ``starts`` (id) along parents, starts included.

    Jumps along the first parents double in length, so that a chain of n
    transactions takes log2(n) rounds and not n; a transaction has one first
    parent, so a jump table has a row for each at most. Other parents of merges
    that were reached are starts of a next climb.
    """
    edges = stored(parents.where("parent_tx_id IS NOT NULL").select("tx_id", "parent_tx_id").distinct())
    jump = stored(edges.groupBy("tx_id").agg(F.min("parent_tx_id").alias("parent_tx_id")))
    others = stored(edges.join(jump, ["tx_id", "parent_tx_id"], "left_anti"))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        far = jump.select(F.col("tx_id").alias("b"), F.col("parent_tx_id").alias("c"))
        jump = stored(jump.join(far, jump["parent_tx_id"] == far["b"]).select("tx_id", F.col("c").alias("parent_tx_id")))
    fresh = stored(starts.select("id").distinct())
    reached = fresh.limit(0)
    while not fresh.isEmpty():
        for jump in jumps:
            up = fresh.join(jump, F.col("id") == F.col("tx_id")).select(F.col("parent_tx_id").alias("id"))
            fresh = stored(fresh.unionByName(up).distinct())
        fresh = stored(fresh.join(reached, "id", "left_anti"))
        reached = stored(reached.unionByName(fresh))
        more = others.join(fresh, F.col("tx_id") == F.col("id")).select(F.col("parent_tx_id").alias("id")).distinct()
        fresh = stored(more.join(reached, "id", "left_anti"))
    return reached


def visible(facts: DataFrame, transactions: DataFrame, provenance: DataFrame, scope: DataFrame) -> DataFrame:
    """Facts seen in a scope, with ``own_ts`` (null if its own transaction isn't in it) and ``visible_ts``.

    A fact is seen if its own transaction is in the scope and not archived, or
    if it supersedes another by an edge whose transaction is. ``visible_ts`` is
    the latest of these. Edges are pre-aggregated by fact: no EXISTS per row.
    """
    live = transactions.where(~F.col("archived")).join(scope, "id", "left_semi").select(F.col("id").alias("tx_id"), "ts")
    own = facts.join(live.withColumnRenamed("ts", "own_ts"), "tx_id", "left")
    by_edge = provenance.where("kind = 'supersedes'").join(live, "tx_id").groupBy(F.col("fact_id").alias("id")).agg(F.max("ts").alias("edge_ts"))
    seen = own.join(by_edge, "id", "left").where("own_ts IS NOT NULL OR edge_ts IS NOT NULL")
    return seen.withColumn("visible_ts", F.greatest("own_ts", "edge_ts")).drop("edge_ts")


def superseded(facts: DataFrame, transactions: DataFrame, provenance: DataFrame, scope: DataFrame) -> DataFrame:
    """Ids of facts that an assert supersedes by an edge of a transaction in scope that isn't archived."""
    live = transactions.where(~F.col("archived")).join(scope, "id", "left_semi").select(F.col("id").alias("tx_id"))
    asserts = facts.where("op = 'assert'").select(F.col("id").alias("fact_id"))
    edges = provenance.where("kind = 'supersedes'").join(live, "tx_id", "left_semi").join(asserts, "fact_id", "left_semi")
    return edges.select(F.col("source_fact_id").alias("id")).distinct()


def current(seen: DataFrame) -> DataFrame:
    """Of seen facts with equal entity, attribute and value the last one (by visible_ts, then id), if it is an assert."""
    by = Window.partitionBy("entity_id", "attribute", "value").orderBy(F.desc("visible_ts"), "id")
    return seen.withColumn("rn", F.row_number().over(by)).where("rn = 1 AND op = 'assert'").drop("rn")


def not_shadowed(seen: DataFrame) -> DataFrame:
    """Asserts with no later one, of either op, of equal entity, attribute and value, by their own transactions' times.

    The other definition of current facts, which semantic recall uses: equal
    times are decided by the smaller id, and a fact that is seen through an
    edge only has no time of its own and is left out.
    """
    own = seen.where("own_ts IS NOT NULL")
    by = Window.partitionBy("entity_id", "attribute", "value").orderBy(F.desc("own_ts"), "id")
    return own.withColumn("rn", F.row_number().over(by)).where("rn = 1 AND op = 'assert'").drop("rn")


def recall(seen: DataFrame, k: int = RECALL[0]) -> DataFrame:
    return seen.orderBy(F.desc("visible_ts"), "id").limit(min(max(k, 1), RECALL[1]))


def trace(provenance: DataFrame, transactions: DataFrame, starts: DataFrame, depth: int = TRACE[0]) -> DataFrame:
    """``(start, id, depth)``: facts that ``starts`` (id) derive from, each at its least depth; archived edges don't count."""
    live = transactions.where(~F.col("archived")).select(F.col("id").alias("tx_id"))
    edges = stored(provenance.join(live, "tx_id", "left_semi").select(F.col("fact_id").alias("at"), F.col("source_fact_id").alias("to")).distinct())
    frontier = stored(starts.select(F.col("id").alias("start"), "id"))
    seen = frontier.withColumn("depth", F.lit(0))
    for level in range(1, min(max(depth, 1), TRACE[1]) + 1):
        to = if_small(frontier).join(edges, F.col("id") == F.col("at")).select("start", F.col("to").alias("id")).distinct()
        frontier = stored(to.join(seen, ["start", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    return seen


def profile(now: DataFrame, definitions: DataFrame, k: int = 5) -> DataFrame:
    """Per entity the last ``k`` current facts of each bucket: static attributes, reflections, and all others."""
    known = now.join(definitions.select(F.col("name").alias("attribute"), "is_code_relation"), "attribute", "left")
    bucket = (
        F.when(F.col("attribute") == "reflection", "summary")
        .when(F.coalesce("is_code_relation", F.lit(False)), "static")
        .otherwise("dynamic")
    )
    by = Window.partitionBy("entity_id", "bucket").orderBy(F.desc("visible_ts"), "id")
    ranked = known.withColumn("bucket", bucket).withColumn("rn", F.row_number().over(by))
    return ranked.where(F.col("rn") <= min(max(k, 1), 200)).select("entity_id", "bucket", "rn", "id", "attribute")


def stale_branches(branches: DataFrame, transactions: DataFrame, cutoff: Column, keep: str = "main") -> DataFrame:
    """``(id, state, archived_now, n_open)`` of branches; abandoned ones, and others whose head is before ``cutoff``, get archived."""
    heads = transactions.select(F.col("id").alias("head_tx_id"), F.col("ts").alias("head_ts"))
    opened = transactions.where(~F.col("archived")).groupBy(F.col("branch_id").alias("id")).agg(F.count("*").alias("n"))
    rows = branches.join(heads, "head_tx_id", "left").join(opened, "id", "left")
    old = F.coalesce("head_ts", "created_at") < cutoff
    gone = (F.col("name") != keep) & ((F.col("state") == "abandoned") | old)
    return rows.select(
        "id",
        F.when(gone, "abandoned").otherwise(F.col("state")).alias("state"),
        gone.alias("archived_now"),
        F.when(gone, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_open"),
    )


def reflection_candidates(now: DataFrame, before: Column, least: int = REFLECT_LEAST, most: int = REFLECT_MOST) -> DataFrame:
    """Per entity its ``most`` oldest facts from before a time, with the number of all; entities of fewer than ``least`` are left out."""
    old = now.where(F.col("visible_ts") < before)
    by = Window.partitionBy("entity_id")
    ranked = old.withColumn("rn", F.row_number().over(by.orderBy("visible_ts", "id"))).where(F.col("rn") <= most)
    totals = old.groupBy("entity_id").agg(F.count("*").alias("total")).where(F.col("total") >= least)
    return ranked.join(totals, "entity_id").select("entity_id", "id", "rn", "total")


def reflections(candidates: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New summary facts (id, entity_id, attribute, value, op) and their audit (summary_fact_id, source_fact_id).

    ``candidates`` (entity_id, id, rn, total): one summary for each entity, whose
    value names its count and the digest of its sources in order; the same
    sources make the same fact, so a second run adds nothing.
    """
    of = candidates.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("sources"))  # at most REFLECT_MOST each
    ids = F.transform("sources", lambda x: x["id"])
    value = F.concat(F.size("sources").cast("string"), F.lit(" facts "), F.sha2(F.array_join(ids, ","), 256))
    made = of.select("entity_id", F.lit("reflection").alias("attribute"), value.alias("value"), F.lit("assert").alias("op"), ids.alias("sources"))
    made = made.withColumn("id", fact_id(*[F.col(c) for c in ("entity_id", "attribute", "value", "op")]))
    made = made.join(facts.select("id"), "id", "left_anti")
    audit = made.select(F.col("id").alias("summary_fact_id"), F.explode("sources").alias("source_fact_id"))
    return made.select("id", "entity_id", "attribute", "value", "op"), audit


def orphan_reflections(facts: DataFrame, audited: DataFrame) -> DataFrame:
    """Reflection facts without an audit row (summary_fact_id)."""
    return facts.where("attribute = 'reflection'").join(audited.select(F.col("summary_fact_id").alias("id")), "id", "left_anti").select("id")
