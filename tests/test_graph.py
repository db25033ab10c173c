import json

import pytest
from pyspark.sql import functions as F

from tidewake.functions.confidence import coerce, gate
from tidewake.operators import cochange, exports, traverse
from tidewake.plans.cypher import QueryError, parse
from tidewake.plans.lower import run

NODE = "id string, kind string, path string, display_name string, symbol string, language_id string"
EDGE = "id string, source_entity_id string, target_entity_id string, kind string, confidence string, provenance string"


def graph(spark, edges):
    names = sorted({n for e in edges for n in e[:2]})
    nodes = spark.createDataFrame([(n, "file", f"src/{n}.ts", n, None, "typescript") for n in names], NODE)
    rows = [(f"{a}-{b}-{k}", a, b, k, c, "import") for a, b, k, c in edges]
    return nodes, spark.createDataFrame(rows, EDGE)


def impact(spark, edges, seeds, depth, fanout=200):
    seed = spark.createDataFrame([(s,) for s in seeds], "seed string")
    return traverse.impact_rows(*graph(spark, edges), seed, depth, fanout)


def dep(a, b, confidence="proven", kind="DEPENDS_ON"):
    return (a, b, kind, confidence)


def test_two_levels(spark):
    rows = impact(spark, [dep("a", "leaf"), dep("b", "leaf"), dep("aa", "a"), dep("bb", "b")], ["leaf"], 5)
    assert {(r.path, r.depth) for r in traverse.affected(rows).collect()} == {("src/a.ts", 1), ("src/b.ts", 1), ("src/aa.ts", 2), ("src/bb.ts", 2)}


def test_fanout_cycle_and_best_confidence(spark):
    rows = impact(spark, [dep(f"d{i}", "leaf") for i in range(5)], ["leaf"], 1, 2)
    assert sorted(r.source for r in rows.collect()) == ["d0", "d1"]
    rows = impact(spark, [dep("b", "a"), dep("c", "b"), dep("a", "c"), dep("c", "b", "heuristic", "MENTIONS")], ["a"], 8)
    got = {(r.path, r.depth, r.confidence) for r in traverse.affected(rows).collect()}
    assert got == {("src/b.ts", 1, "proven"), ("src/c.ts", 2, "proven"), ("src/a.ts", 3, "proven")}


def test_gate_truth_table(spark):
    df = spark.createDataFrame([("heuristic",), ("inferred",)], "confidence string")
    want = {"any": True, "none": False, "proven": False, "inferred": True, "heuristic": True}
    assert {k: gate(df, k).first().failed for k in want} == want
    assert gate(df.limit(0), "any").first().failed is False
    with pytest.raises(ValueError, match="gate"):
        gate(df, "sure")
    assert df.select(coerce(F.lit("x")).alias("c")).first().c == "unknown"


EDGES = [dep("alpha", "beta"), dep("cee", "bee"), dep("bee", "ay"), dep("one", "shared"), dep("two", "shared"), dep("only", "solo")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("MATCH (a)-[r:DEPENDS_ON]->(b) WHERE a.name = 'alpha' RETURN a.path, b.path, r.kind", [("src/alpha.ts", "src/beta.ts", "DEPENDS_ON")]),
        ("match (b)<-[r:depends_on]-(a) where b.path contains 'BETA' return a.name", [("alpha",)]),
        ("MATCH (c)-[:DEPENDS_ON*1..3]->(d) WHERE c.name = 'cee' RETURN d.name", [("ay",), ("bee",)]),
        ("MATCH (c)-[*2]->(d) RETURN c.name, d.name", [("cee", "ay")]),
        ("MATCH (c)-[*9]->(d) RETURN c.name", []),
        ("MATCH (a)-[r]->(b) RETURN b.name, COUNT(a) ORDER BY COUNT(a) DESC, b.name LIMIT 2", [("shared", 2), ("ay", 1)]),
        ("MATCH (a:File) WHERE a.name = 'RETURN' AND a.id = 'x' RETURN a", []),
    ],
)
def test_queries(spark, text, want):
    assert [tuple(r) for r in run(text, *graph(spark, EDGES)).collect()] == want


@pytest.mark.parametrize(
    "text",
    [
        "CREATE (a) RETURN a", "MATCH (a) SET a.x = 'y' RETURN a", "MATCH (a)-[r]->(b) RETURN COUNT(*)", "MATCH (a)-[r*]->(b) RETURN COUNT(a)",
        "MATCH (a) RETURN a.path ORDER BY a.name", "MATCH (a) RETURN b", "MATCH (a) RETURN a.size", "MATCH (a)-[r*1..2]->(b) RETURN r.kind",
        "MATCH (a)-[*3..2]->(b) RETURN a", "MATCH (a) WITH a RETURN a", "MATCH (a)<-[r]->(b) RETURN a", "MATCH (a) RETURN a LIMIT x", "RETURN 1",
    ],
)
def test_rejected(text):
    with pytest.raises(QueryError):
        parse(text)


def commits(spark, baskets):
    return spark.createDataFrame([(i, p) for i, b in enumerate(baskets) for p in b], "commit int, path string")


@pytest.mark.parametrize(
    "baskets,options,n",
    [
        ([["a", "b"]] * 3, {}, 2), ([["a", "b"]] * 2, {}, 0), ([["a", "b"]] * 3 + [["a"]] * 7, {"min_score": 0.31}, 0), ([["a", "b"]] * 3 + [["a"]] * 7, {}, 2),
        ([[f"f{i}" for i in range(30)]] * 3, {}, 0), ([["a", "b", "a"]] * 3, {}, 2),
    ],
)
def test_co_change(spark, baskets, options, n):
    assert cochange.co_changes(commits(spark, baskets), **options).count() == n


def test_included_files_and_promotion(spark):
    only = spark.createDataFrame([("a",)], "path string")
    assert cochange.co_changes(commits(spark, [["a", "R"]] * 3), included=only).count() == 0
    _, rel = graph(spark, [dep("beta", "alpha", "heuristic", "CO_CHANGES"), dep("x", "y")])
    seen = spark.createDataFrame([("beta", "alpha"), ("beta", "alpha"), ("x", "y"), ("q", "r")], "source string, target string")
    raised, counts = cochange.promote(rel, seen)
    assert {r.confidence for r in raised.collect()} == {"proven"}
    assert tuple(counts.first()) == (1, 1, 1)


def test_exports_and_pages(spark):
    nodes, rel = graph(spark, [dep('a"', "b"), dep("c", "b", "heuristic")])
    assert '"a\\"" -> "b" [label="DEPENDS_ON"];' in exports.dot(rel).first().text
    assert exports.mermaid(rel).first().text.startswith("flowchart LR\n")
    hit = traverse.affected(impact(spark, [dep("x.test", "b"), dep("c", "b", "heuristic")], ["b"], 1))
    doc = json.loads(exports.sarif(hit).first().text)
    assert [r["level"] for r in doc["runs"][0]["results"]] == ["error", "note"]
    assert "Affected: 2" in exports.markdown(hit).first().text
    assert [r.command for r in exports.verify_commands(hit).collect()] == ["npx vitest run src/x.test.ts"]
    labels = spark.createDataFrame([(0,), (3,), (12,), (13,)], "n int").select(exports.blast_label(F.col("n")).alias("l")).collect()
    assert [r.l for r in labels] == ["clear", "contained", "expanding", "wide"]
    with pytest.raises(ValueError, match="limit"):
        traverse.page(nodes, [F.col("id")], 0, 501)
    assert [r.id for r in traverse.page(nodes, [F.col("id")], 1, 1).collect()] == ["b"]
    assert [traverse.bounded(x, traverse.DEPTH) for x in (None, 0, 3.7, 99)] == [2, 1, 3, 8]
