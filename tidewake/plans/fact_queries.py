"""Queries over a fact store made of the events table, and their SQL.

An event is a fact of its user in a transaction of its own. A transaction's
parent is the user's event before; every fifth event supersedes or cites that
one's fact; users are dealt to four branches.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.operators import facts as store
from tidewake.plans.graph_views import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("tx_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tx_id"),
        "ts",
        "user_id",
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity_id"),
        F.when(F.col("event_id") % 11 == 0, "reflection").otherwise(F.col("event_type")).alias("attribute"),
        F.coalesce("props", F.lit("null")).alias("value"),
        F.when(F.col("event_id") % 7 == 0, "retract").otherwise("assert").alias("op"),
    )
    rows = rows.withColumn("id", store.fact_id(*[F.col(c) for c in ("entity_id", "attribute", "value", "op")]))
    return rows.withColumns({"before_tx": F.lag("tx_id").over(by), "before_id": F.lag("id").over(by)})


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """facts, transactions, parents, provenance and branches."""
    e = _events(spark, sf_dir)
    none = spark.createDataFrame([], "id string, entity_id string, attribute string, value string, op string, tx_id long, redacted boolean")
    branch = F.concat(F.lit("br_"), (F.col("user_id") % 4).cast("string"))
    transactions = e.select(F.col("tx_id").alias("id"), branch.alias("branch_id"), "ts", (F.col("tx_id") % 13 == 0).alias("archived"))
    heads = transactions.groupBy("branch_id").agg(F.max("id").alias("head_tx_id"), F.min("ts").alias("created_at"))
    return {
        "facts": store.remember(none, e.withColumn("redacted", F.lit(False))),
        "transactions": transactions,
        "parents": e.select("tx_id", F.col("before_tx").alias("parent_tx_id")),
        "provenance": e.where("before_id IS NOT NULL AND tx_id % 5 = 0").select(
            F.col("id").alias("fact_id"),
            F.col("before_id").alias("source_fact_id"),
            F.when(F.col("tx_id") % 10 == 0, "supersedes").otherwise("evidence").alias("kind"),
            "tx_id",
        ),
        "branches": heads.select(
            F.col("branch_id").alias("id"),
            F.when(F.col("branch_id") == "br_0", "main").otherwise(F.col("branch_id")).alias("name"),
            "head_tx_id",
            F.when(F.col("branch_id") == "br_3", "abandoned").otherwise("active").alias("state"),
            "created_at",
        ),
    }


def _seen(v: dict[str, DataFrame], scope: DataFrame) -> DataFrame:
    return store.visible(v["facts"], v["transactions"], v["provenance"], scope)


def _all(v: dict[str, DataFrame]) -> DataFrame:
    return v["transactions"].select("id")


def fact_log(spark, sf_dir):
    return views(spark, sf_dir)["facts"].select("id", "entity_id", "attribute", "op", "tx_id")


def facts_current(spark, sf_dir):
    v = views(spark, sf_dir)
    return store.current(_seen(v, _all(v))).select("id", "entity_id", "attribute", "visible_ts")


def facts_not_shadowed(spark, sf_dir):
    v = views(spark, sf_dir)
    return store.not_shadowed(_seen(v, _all(v))).select("id", "entity_id", "attribute", "own_ts")


def facts_superseded(spark, sf_dir):
    v = views(spark, sf_dir)
    return store.superseded(v["facts"], v["transactions"], v["provenance"], _all(v))


def fact_recall(spark, sf_dir):
    """The last hundred facts that are current on a branch and not superseded there."""
    v = views(spark, sf_dir)
    scope = store.branch_scope(v["transactions"], "br_1")
    hidden = store.superseded(v["facts"], v["transactions"], v["provenance"], scope)
    return store.recall(store.current(_seen(v, scope)).join(hidden, "id", "left_anti"), 100).select("id", "entity_id", "visible_ts")


def fact_as_of(spark, sf_dir):
    """Facts as of each user's middle transaction, by number; of an even count the earlier of the two."""
    v = views(spark, sf_dir)
    of_user = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"))
    e = e.select("id", F.row_number().over(of_user.orderBy("id")).alias("k"), F.count("*").over(of_user).alias("n"))
    starts = e.where("k = (n + 1) div 2").select("id")
    return _seen(v, store.ancestors(v["parents"], starts)).select("id", "entity_id", "visible_ts")


def fact_trace(spark, sf_dir):
    v = views(spark, sf_dir)
    starts = v["provenance"].select(F.col("fact_id").alias("id")).distinct()
    out = store.trace(v["provenance"], v["transactions"], starts)
    return out.select("start", "id", F.col("depth").cast("long").alias("depth"))


def fact_profile(spark, sf_dir):
    v = views(spark, sf_dir)
    known = spark.sql("SELECT * FROM VALUES ('purchase', true), ('click', false) AS d(name, is_code_relation)")
    out = store.profile(store.current(_seen(v, _all(v))), known)
    return out.select("entity_id", "bucket", F.col("rn").cast("long").alias("rn"), "id", "attribute")


def branch_gc(spark, sf_dir):
    v = views(spark, sf_dir)
    cutoff = v["transactions"].agg(F.max("ts").alias("last"))  # one row
    rows = v["branches"].crossJoin(cutoff)
    out = store.stale_branches(rows, v["transactions"], F.col("last") - F.expr("INTERVAL 1 DAY"))
    return out.select("id", "state", "archived_now", F.col("n_open").cast("long").alias("n_open"))


def reflect_candidates(spark, sf_dir):
    v = views(spark, sf_dir)
    last = v["transactions"].agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("before"))
    now = store.current(_seen(v, _all(v))).crossJoin(F.broadcast(last))  # one row
    out = store.reflection_candidates(now, F.col("before"))
    return out.select("entity_id", "id", F.col("rn").cast("long").alias("rn"), F.col("total").cast("long").alias("total"))


def reflect_orphans(spark, sf_dir):
    v = views(spark, sf_dir)
    audited = v["facts"].where("tx_id % 2 = 0").select(F.col("id").alias("summary_fact_id"))
    return store.orphan_reflections(v["facts"], audited)


def _at(v: dict[str, DataFrame]):
    return F.lit("2030-01-01 00:00:00").cast(v["transactions"].schema["ts"].dataType)


def fact_branch_merge(spark, sf_dir):
    """What is current on br_1 after br_2 was forked to br_9, and br_9 merged into br_1."""
    v = views(spark, sf_dir)
    graph = v["transactions"], v["branches"], v["parents"]
    graph = store.fork(*graph, "br_9", "br_2", -1, _at(v))
    transactions, branches, parents = store.merge(*graph, "br_9", "br_1", -2, _at(v))
    head = branches.where("id = 'br_1'").select(F.col("head_tx_id").alias("id"))
    scope = store.ancestors(parents, head)
    now = store.current(store.visible(v["facts"], transactions, v["provenance"], scope))
    return now.select("id", "entity_id", "visible_ts")


def branch_states(spark, sf_dir):
    """Branches after a fork, a merge of the fork, and the return of the abandoned branch; with the transactions of each that are open."""
    v = views(spark, sf_dir)
    graph = store.fork(v["transactions"], v["branches"], v["parents"], "br_9", "br_2", -1, _at(v))
    transactions, branches, _ = store.merge(*graph, "br_9", "br_1", -2, _at(v))
    gone = branches.where("state = 'abandoned'").select(F.col("id").alias("branch_id"))
    shut = transactions.join(gone.withColumn("gone", F.lit(True)), "branch_id", "left")
    shut = shut.withColumn("archived", F.col("archived") | F.coalesce("gone", F.lit(False))).select(*transactions.columns)
    branches, transactions = store.restore(branches, shut, "br_3")
    opened = transactions.where("NOT archived").groupBy(F.col("branch_id").alias("id")).agg(F.count("*").alias("n_open"))
    return branches.join(opened, "id").select("id", "state", "head_tx_id", "n_open")


def facts_rejected(spark, sf_dir):
    """Facts that may not be remembered, where every tenth lacks an entity and some cite or supersede wrongly."""
    v = views(spark, sf_dir)
    new = v["facts"].select(
        "id", F.when(F.col("tx_id") % 30 == 0, " ").otherwise(F.col("entity_id")).alias("entity_id"), "attribute",
        F.when(F.col("tx_id") % 31 == 0, "forget").otherwise(F.col("op")).alias("op"),
    )
    p = v["provenance"]
    edges = p.select("fact_id", F.when(F.col("tx_id") % 50 == 0, F.col("fact_id")).otherwise(F.col("source_fact_id")).alias("source_fact_id"), "kind")
    more = p.where("tx_id % 35 = 0").select("fact_id", "source_fact_id", F.lit("cites").alias("kind"))
    return store.rejected(new, edges.unionByName(more))


def facts_retracted(spark, sf_dir):
    """Retractions of every current purchase."""
    v = views(spark, sf_dir)
    now = store.current(_seen(v, _all(v)))
    return store.retract(now, now.where("attribute = 'purchase'")).select("id", "entity_id", "op")


def fact_semantic(spark, sf_dir):
    """The best forty of all facts not shadowed by a score that their ids make."""
    v = views(spark, sf_dir)
    scores = v["facts"].select("id", F.conv(F.substring("id", 1, 6), 16, 10).cast("double").alias("score"))
    out = store.semantic_recall(_seen(v, _all(v)), scores, 40)
    return out.select("id", "score", F.col("rank").cast("long").alias("rank"))


def reflect_persisted(spark, sf_dir):
    """Summary facts and the number of their sources, and what a second run would add."""
    v = views(spark, sf_dir)
    last = v["transactions"].agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("before"))
    now = store.current(_seen(v, _all(v))).crossJoin(F.broadcast(last))  # one row
    candidates = store.reflection_candidates(now, F.col("before"))
    made, audit = store.reflections(candidates, v["facts"])
    again = store.reflections(candidates, made)[0].select("id", F.lit(True).alias("again"))
    sources = audit.groupBy(F.col("summary_fact_id").alias("id")).agg(F.count("*").alias("n_sources"))
    out = made.join(sources, "id").join(again, "id", "left")
    return out.select("id", "entity_id", "value", "n_sources", F.coalesce("again", F.lit(False)).alias("again"))


QUERIES = {
    f.__name__: f
    for f in (
        fact_log, facts_current, facts_not_shadowed, facts_superseded, fact_recall, fact_as_of, fact_trace, fact_profile,
        branch_gc, reflect_candidates, reflect_orphans, fact_branch_merge, branch_states, facts_rejected, facts_retracted, fact_semantic, reflect_persisted,
    )
}

_VIEWS = """e AS (SELECT *, sha256(entity_id || chr(31) || attribute || chr(31) || value || chr(31) || op) AS id FROM (
    SELECT event_id AS tx_id, ts, user_id, 'user:' || CAST(user_id AS VARCHAR) AS entity_id,
           CASE WHEN event_id % 11 = 0 THEN 'reflection' ELSE event_type END AS attribute, coalesce(props, 'null') AS value,
           CASE WHEN event_id % 7 = 0 THEN 'retract' ELSE 'assert' END AS op FROM events)),
  b AS (SELECT *, lag(tx_id) OVER w AS before_tx, lag(id) OVER w AS before_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY tx_id)),
  facts AS (SELECT id, entity_id, attribute, value, op, tx_id FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, tx_id) = 1),
  transactions AS (SELECT tx_id AS id, 'br_' || CAST(user_id % 4 AS VARCHAR) AS branch_id, ts, tx_id % 13 = 0 AS archived FROM e),
  provenance AS (SELECT id AS fact_id, before_id AS source_fact_id, CASE WHEN tx_id % 10 = 0 THEN 'supersedes' ELSE 'evidence' END AS kind, tx_id
                 FROM b WHERE before_id IS NOT NULL AND tx_id % 5 = 0)"""


@cache
def _scoped(scope: str) -> str:
    """Views of what is seen in a scope; ``scope`` is SQL of transaction ids."""
    return f"""live AS (SELECT id AS tx_id, ts FROM transactions WHERE NOT archived AND id IN ({scope})),
  seen AS (SELECT f.*, l.ts AS own_ts, (SELECT max(v.ts) FROM (SELECT l.ts UNION ALL SELECT m.ts FROM provenance p JOIN live m ON m.tx_id = p.tx_id
           WHERE p.kind = 'supersedes' AND p.fact_id = f.id) v) AS visible_ts FROM facts f LEFT JOIN live l ON l.tx_id = f.tx_id),
  shown AS (SELECT * FROM seen WHERE visible_ts IS NOT NULL),
  now AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY entity_id, attribute, value ORDER BY visible_ts DESC, id) = 1 AND op = 'assert'),
  hidden AS (SELECT DISTINCT source_fact_id AS id FROM provenance p WHERE kind = 'supersedes' AND tx_id IN (SELECT tx_id FROM live)
             AND EXISTS (SELECT 1 FROM facts f WHERE f.id = p.fact_id AND f.op = 'assert'))"""


_ALL = _scoped("SELECT id FROM transactions")
_BRANCH = _scoped("SELECT id FROM transactions WHERE branch_id = 'br_1'")
_PAST = _scoped("SELECT id FROM past")
ORACLES = {
    "fact_log": f"WITH {_VIEWS} SELECT id, entity_id, attribute, op, tx_id FROM facts",
    "facts_current": f"WITH {_VIEWS}, {_ALL} SELECT id, entity_id, attribute, visible_ts FROM now",
    "facts_not_shadowed": f"WITH {_VIEWS}, {_ALL} SELECT id, entity_id, attribute, own_ts FROM seen WHERE own_ts IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY entity_id, attribute, value ORDER BY own_ts DESC, id) = 1 AND op = 'assert'",
    "facts_superseded": f"WITH {_VIEWS}, {_ALL} SELECT id FROM hidden",
    "fact_recall": f"WITH {_VIEWS}, {_BRANCH} SELECT id, entity_id, visible_ts FROM now WHERE id NOT IN (SELECT id FROM hidden) ORDER BY visible_ts DESC, id LIMIT 100",
    "fact_as_of": f"WITH RECURSIVE {_VIEWS}, mid AS (SELECT tx_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY tx_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e), past(id) AS (SELECT id FROM mid WHERE k = (n + 1) // 2 UNION SELECT before_tx FROM past JOIN b ON b.tx_id = past.id "
    f"WHERE before_tx IS NOT NULL), {_PAST} SELECT id, entity_id, visible_ts FROM shown",
    "fact_trace": f"WITH RECURSIVE {_VIEWS}, g AS (SELECT DISTINCT fact_id, source_fact_id FROM provenance WHERE tx_id IN (SELECT id FROM transactions WHERE NOT archived)), "
    "t(start, id, depth) AS (SELECT DISTINCT fact_id, fact_id, 0 FROM provenance UNION SELECT start, source_fact_id, depth + 1 FROM t JOIN g ON fact_id = t.id WHERE depth < 5) "
    "SELECT start, id, CAST(min(depth) AS BIGINT) AS depth FROM t GROUP BY start, id",
    "fact_profile": f"WITH {_VIEWS}, {_ALL} SELECT entity_id, bucket, row_number() OVER (PARTITION BY entity_id, bucket ORDER BY visible_ts DESC, id) AS rn, id, attribute "
    "FROM (SELECT *, CASE attribute WHEN 'reflection' THEN 'summary' WHEN 'purchase' THEN 'static' ELSE 'dynamic' END AS bucket FROM now) "
    "QUALIFY row_number() OVER (PARTITION BY entity_id, bucket ORDER BY visible_ts DESC, id) <= 5",
    "branch_gc": f"WITH {_VIEWS}, h AS (SELECT branch_id AS id, arg_max(ts, id) AS head_ts FROM transactions GROUP BY branch_id), "
    "n AS (SELECT branch_id AS id, count(*) AS n FROM transactions WHERE NOT archived GROUP BY branch_id), "
    "r AS (SELECT id, n, id <> 'br_0' AND (id = 'br_3' OR head_ts < (SELECT max(ts) FROM transactions) - INTERVAL 1 DAY) AS gone FROM h JOIN n USING (id)) "
    "SELECT id, CASE WHEN gone OR id = 'br_3' THEN 'abandoned' ELSE 'active' END AS state, gone AS archived_now, CAST(CASE WHEN gone THEN n ELSE 0 END AS BIGINT) AS n_open FROM r",
    "reflect_candidates": f"WITH {_VIEWS}, {_ALL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY visible_ts, id) AS rn, count(*) OVER (PARTITION BY entity_id) AS total "
    "FROM now WHERE visible_ts < (SELECT max(ts) FROM transactions) - INTERVAL 10 DAY) SELECT entity_id, id, rn, total FROM o WHERE rn <= 50 AND total >= 2",
    "reflect_orphans": f"WITH {_VIEWS} SELECT id FROM facts WHERE attribute = 'reflection' AND tx_id % 2 <> 0",
    "fact_branch_merge": f"WITH RECURSIVE {_VIEWS}, heads AS (SELECT branch_id, max(id) AS h FROM transactions GROUP BY branch_id), "
    f"past(id) AS (SELECT h FROM heads WHERE branch_id IN ('br_1', 'br_2') UNION SELECT before_tx FROM past JOIN b ON b.tx_id = past.id WHERE before_tx IS NOT NULL), {_PAST} "
    "SELECT id, entity_id, visible_ts FROM now",
    "branch_states": f"WITH {_VIEWS}, h AS (SELECT branch_id AS id, max(id) AS head_tx_id, count(*) FILTER (WHERE NOT archived) AS n, count(*) AS n_all FROM transactions GROUP BY branch_id) "
    "SELECT id, 'active' AS state, CASE id WHEN 'br_1' THEN -2 ELSE head_tx_id END AS head_tx_id, CASE id WHEN 'br_1' THEN n + 1 WHEN 'br_3' THEN n_all ELSE n END AS n_open FROM h "
    "UNION ALL SELECT 'br_9', 'merged', -1, 1",
    "facts_rejected": f"WITH {_VIEWS}, p AS (SELECT fact_id, CASE WHEN tx_id % 50 = 0 THEN fact_id ELSE source_fact_id END AS source_fact_id, kind FROM provenance "
    "UNION ALL SELECT fact_id, source_fact_id, 'cites' FROM provenance WHERE tx_id % 35 = 0) "
    "SELECT id, CASE WHEN tx_id % 30 = 0 THEN 'unnamed' ELSE 'unknown op' END AS reason FROM facts WHERE tx_id % 30 = 0 OR tx_id % 31 = 0 "
    "UNION SELECT fact_id, 'supersedes itself' FROM p WHERE fact_id = source_fact_id AND kind = 'supersedes' "
    "UNION SELECT fact_id, 'evidence that it supersedes' FROM p GROUP BY fact_id, source_fact_id HAVING count(DISTINCT kind) > 1",
    "facts_retracted": f"WITH {_VIEWS}, {_ALL} SELECT DISTINCT sha256(entity_id || chr(31) || attribute || chr(31) || value || chr(31) || 'retract') AS id, entity_id, 'retract' AS op "
    "FROM now WHERE attribute = 'purchase'",
    "fact_semantic": f"WITH {_VIEWS}, {_ALL}, u AS (SELECT id, own_ts, CAST(('0x' || left(id, 6))::BIGINT AS DOUBLE) AS score FROM (SELECT * FROM seen WHERE own_ts IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY entity_id, attribute, value ORDER BY own_ts DESC, id) = 1 AND op = 'assert')) "
    "SELECT id, score, row_number() OVER (ORDER BY score DESC, own_ts DESC, id) AS rank FROM u QUALIFY row_number() OVER (ORDER BY score DESC, own_ts DESC, id) <= 40",
    "reflect_persisted": f"WITH {_VIEWS}, {_ALL}, o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY visible_ts, id) AS rn, count(*) OVER (PARTITION BY entity_id) AS total "
    "FROM now WHERE visible_ts < (SELECT max(ts) FROM transactions) - INTERVAL 10 DAY), "
    "m AS (SELECT entity_id, count(*) AS n, CAST(count(*) AS VARCHAR) || ' facts ' || sha256(string_agg(id, ',' ORDER BY rn)) AS value FROM o WHERE rn <= 50 AND total >= 2 GROUP BY entity_id) "
    "SELECT sha256(entity_id || chr(31) || 'reflection' || chr(31) || value || chr(31) || 'assert') AS id, entity_id, value, n AS n_sources, false AS again FROM m",
}
