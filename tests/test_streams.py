import duckdb

from tidewake.operators import streams as st
from tidewake.plans import search_queries as sq

ENTITIES = "id string, kind string, path string, display_name string, symbol string"
RELATIONS = "id string, source_entity_id string, target_entity_id string, kind string, confidence string, provenance string"


def ranks(df):
    return {r.id: r["rank"] for r in df.collect()}


def test_streams(spark):
    e = spark.createDataFrame([("a", "file", "x_1", "n", None), ("b", "test", None, "x_1", "x_1"), ("c", "file", "x_1", "m", None), ("d", "file", "xa1", "X_1", None)], ENTITIES)
    assert ranks(st.entity_stream(e, "X_1")) == {"c": 1, "a": 2, "b": 3, "d": 4}  # _ is no wildcard; symbols count before files
    assert ranks(st.entity_stream(e, "X_1", 1)) == {"c": 1} and ranks(st.entity_stream(e, "none")) == {}
    r = spark.createDataFrame([("1", "a", "b", "CALLS", "proven", "ast"), ("2", "a", "a", "CALLS", "proven", None), ("3", "z", "c", "USES", "proven", "recalls")], RELATIONS)
    assert ranks(st.relation_stream(e, r, "call")) == {"a": 1, "c": 2, "b": 3}
    proof = spark.createDataFrame([("i", "1", "s.ts", "call", "load_all(x)"), ("j", "3", "t.ts", None, None)], "id string, relation_id string, file_path string, kind string, snippet string")
    assert ranks(st.evidence_stream(e, r, proof, "loa call")) == {"a": 1, "b": 2}
    assert ranks(st.evidence_stream(e, r, proof, "oad")) == {"a": 1, "b": 2}  # no token begins so
    assert ranks(st.evidence_stream(e, r, proof, "t.ts")) == {"c": 1}
    assert ranks(st.evidence_stream(e, r, proof, "loa call", terms=False)) == {}
    seen = spark.createDataFrame([("f", "a", "k", "red", "assert", False), ("g", "b", "k", "red", "assert", True), ("h", "c", "k", "red", "assert", False), ("k", "c", "k", "red", "retract", False)],
                                 "id string, entity_id string, attribute string, value string, op string, redacted boolean")
    facts = st.fact_stream(e, seen, spark.createDataFrame([("h",)], "id string"), "re")
    assert ranks(facts) == {"a": 1} and ranks(st.fact_stream(e, seen, seen.select("id").limit(0), "re:d")) == {}
    assert ranks(st.after(st.relation_stream(e, r, "uses"), facts.unionByName(facts.withColumn("id", st.F.lit("c"))))) == {"c": 1, "a": 2}


def test_scores(spark):
    want = spark.createDataFrame([("a", "b", "K", "x"), ("a", "c", "K", "x")], "source string, target string, kind string, adapter string")
    got = spark.createDataFrame([("a", "b", "K", "y", 1, 0), ("q", "c", "K", "x", 1, 1)], "source string, target string, kind string, adapter string, n_evidence int, n_spans int")
    assert tuple(st.index_scores(want, got).first()) == (0.5, 0.5, 0.5, 0.0, 0.0)
    assert tuple(st.index_scores(want.limit(0), got.limit(0)).first()) == (1.0,) * 5
    whole = st.weighted_score(st.index_scores(want.limit(0), got.limit(0)).selectExpr("*", "1.0 AS affected_recall", "1.0 AS pack_readiness"))
    assert whole.first()["score"] == 1.0
    metrics = spark.createDataFrame([("q", 0.5), ("r", 1.0)], "query string, mrr double")
    assert st.mean_metrics(metrics).first()["mrr"] == 0.75 and st.mean_metrics(metrics.limit(0)).first()["mrr"] == 1.0


def test_diversified_search_reaches_sources_beyond_1500_results(spark, tmp_path):
    n = 40_000  # with its own vector for a neighbour every twentieth row is found, 2000 of them
    ids = spark.range(n)
    text = st.F.expr("CASE WHEN id < 100 THEN concat('licensed under the license ', id) ELSE concat('text ', id) END")
    late = st.F.expr("CASE WHEN id >= 38000 THEN 'late' WHEN id % 40 = 0 THEN 'a' ELSE 'b' END")
    ids.select(st.F.col("id").alias("doc_id"), text.alias("text"), late.alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    alone = st.F.expr("transform(sequence(0, 63), i -> CAST(IF(i = id % 64, 1.0, 0.0) AS FLOAT))")
    ids.where("id % 20 = 0").select(st.F.col("id").alias("vec_id"), st.F.col("id").cast("int").alias("label"), alone.alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sq.diversified_search(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT id, source, place, total FROM ({sq.ORACLES['diversified_search']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and {r.source for r in got} == {"a", "b", "late"}
