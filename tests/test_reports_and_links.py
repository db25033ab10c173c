import pytest

from tidewake.operators import links as ln
from tidewake.operators import reports as rp

ENTITIES = "id string, path string"
RELATIONS = "id string, source_entity_id string, target_entity_id string, kind string, confidence string"
LINKS = "id string, kind string, source_repo string, target_repo string, confidence string, provenance string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_report_merges_seeds_and_falls_back(spark):
    entities = spark.createDataFrame([(c, f"{c}.ts") for c in "abcd"], ENTITIES)
    # b -> a, c -> b; nothing points to c or d
    relations = spark.createDataFrame([("1", "b", "a", "CALLS", "heuristic"), ("2", "c", "b", "CALLS", "proven")], RELATIONS)
    changed = spark.createDataFrame([("a.ts",), ("b.ts",), ("d.ts",), ("new.ts",), ("a.ts",)], "path string")
    legacy = spark.createDataFrame([("x.ts", "d.ts", "IMPORTS", "inferred"), ("y.ts", "a.ts", "IMPORTS", "proven")], "source_path string, target_path string, kind string, confidence string")
    cross = spark.createDataFrame([("svc:q.ts", "inferred", "cross-repo")], "path string, confidence string, reason string")
    out = rp.impact_report(entities, relations, changed, legacy, cross, max_depth=3)
    assert rows(out) == [
        ("b.ts", 1, "heuristic", "CALLS"), ("c.ts", 1, "proven", "CALLS"), ("new.ts", 0, "unknown", rp.NOT_INDEXED),
        ("svc:q.ts", 1, "inferred", "cross-repo"), ("x.ts", 1, "inferred", "IMPORTS"),
    ]
    assert rows(rp.impact_report(entities, relations, changed.limit(0))) == []
    proof = spark.createDataFrame([("b.ts",), ("b.ts",), (None,)], "file_path string")
    assert {r.path: r.n_evidence for r in rp.evidence_counts(out, proof).collect()} == {"b.ts": 2, "c.ts": 0, "new.ts": 0, "svc:q.ts": 0, "x.ts": 0}
    listed = rp.ui_order(out, spark.createDataFrame([("x.ts",)], "path string"))
    assert [r.path for r in listed.collect()] == ["x.ts", "c.ts", "svc:q.ts", "b.ts", "new.ts"]


def test_stale_index(spark):
    files = "path string, content_hash string"
    indexed = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], files)
    live = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None), ("e", "5")], files)
    changed = spark.createDataFrame([(c,) for c in "abcdeb"], "path string")
    assert rows(rp.stale_warnings(changed, indexed, live)) == [("b", "stale"), ("c", "unreadable"), ("d", "unreadable"), ("e", "coverage gap")]
    runs = spark.createDataFrame([(1, "r", "x", False), (2, "r", "y", True), (3, "r", None, True), (4, "gone", "x", False)], "run int, repo string, commit_sha string, is_dirty boolean")
    now = spark.createDataFrame([("r", "y", True)], "repo string, commit_sha string, is_dirty boolean")
    assert rows(rp.snapshot_warnings(runs, now)) == [(1, "head moved"), (1, "tree is dirty"), (2, "run was dirty")]


def test_lanes(spark):
    report = spark.createDataFrame(
        [("src/a.ts", 2, "proven", "CALLS"), ("src/b.ts", 1, "proven", "CALLS"), ("docs/x.md", 1, "inferred", "x"), ("api/openapi.yaml", 1, "proven", "x"), ("package.json", 1, "proven", "x"),
         ("svc:q", 1, "inferred", "cross-repo BREAKS_COMPATIBILITY_WITH"), ("src/z.ts", 1, "unknown", "CALLS")],
        "path string, depth int, confidence string, reason string",
    )
    paths = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    out = {r.lane: (r.n, r.top_path) for r in rp.lanes(report, paths("src/z.ts"), paths("docs/x.md", "docs/y.md")).collect()}
    assert out == {
        "code": (2, "src/b.ts"), "tests": (1, "src/z.ts"), "knowledge": (2, "docs/x.md"), "crossRepo": (1, "svc:q"), "contracts": (1, "api/openapi.yaml"), "config": (1, "package.json"),
    }
    empty = rp.lanes(report.limit(0), paths(), paths("d.md"))
    assert {r.lane: r.n for r in empty.collect()} == {x: int(x == "knowledge") for x in rp.LANES}


@pytest.mark.parametrize("policy,summary", [("default", "wider"), ("strict", "wider"), ("relaxed", "unchanged"), ("action-heavy", "wider")])
def test_report_deltas(spark, policy, summary):
    reports = spark.createDataFrame([("a", 1, 5, 0, 1), ("b", 1, 5, 2, 3), ("c", 2, 1, 0, 0)], "id string, repo int, created_at int, n_actions int, n_evidence int")
    affected = spark.createDataFrame([("a", "p", "proven"), ("a", "q", "unknown"), ("b", "q", "proven"), ("b", "r", "proven")], "id string, path string, confidence string")
    (r,) = rp.report_deltas(reports, affected, policy).collect()
    assert (r.id, r.base, r.summary, r.added, r.removed, r.n_affected_delta, r.proven_delta, r.unknown_delta) == ("b", "a", summary, 1, 1, 0, 1, -1)
    assert r.load == 2 * rp.POLICIES[policy][1] + 2


@pytest.fixture
def store(spark):
    contracts = spark.createDataFrame([("c", "p", "api.json"), ("d", "p", "two.json")], "contract_id string, repo string, path string")
    calls = spark.createDataFrame([("c", "GET", "/a", "q", "x.ts"), ("c", "GET", "/a", "q", "x.ts"), ("c", "POST", "/b", "q", "y.ts"), ("d", "GET", "/a", "r", "z.ts")], "contract_id string, method string, route string, repo string, path string")
    changes = spark.createDataFrame([("c", "GET", "/a", "removed_endpoint", "breaking"), ("c", "POST", "/b", "added_endpoint", "non-breaking")], "contract_id string, method string, route string, kind string, classification string")
    consumed = ln.consumer_links(calls, contracts)
    return contracts, consumed, ln.break_links(changes, calls, contracts)


def test_links_and_lookups(spark, store):
    contracts, consumed, broken = store
    assert consumed.count() == 3 and broken.count() == 1
    assert {r.consumer_path for r in ln.consumers_of(consumed, "p").collect()} == {"x.ts", "y.ts", "z.ts"}
    assert [r.consumer_path for r in ln.consumers_of(consumed, "p", "api.json", "post").collect()] == ["y.ts"]
    assert [r.route for r in ln.providers_for(consumed, "r").collect()] == ["/a"] and ln.providers_for(consumed, "q", "z.ts").isEmpty()
    again = ln.replace_links(consumed.unionByName(broken), consumed.unionByName(consumed), ln.CONSUMES)
    assert rows(again) == rows(consumed.unionByName(broken))
    changed = spark.createDataFrame([("p", "api.json")], "repo string, path string")
    assert [(r.path, r.confidence) for r in ln.cross_impacts(again, changed).collect()] == [("q:x.ts", "inferred")]
    assert ln.cross_impacts(again, spark.createDataFrame([("p", "two.json")], "repo string, path string")).isEmpty()
    assert ln.select_provider(contracts, "p", "two.json") == "d"
    for bad in (("p", None), ("none", None)):
        with pytest.raises(ValueError, match="contract of"):
            ln.select_provider(contracts, *bad)


def test_diagnostics_and_listing(spark, store):
    _, consumed, broken = store
    members = spark.createDataFrame([("p",), ("q",), ("q",)], "repo string")
    bad = spark.createDataFrame([("m", ln.BREAKS, "q", "p", "inferred", "{"), ("n", ln.BREAKS, "q", "p", "inferred", None)], LINKS)
    links = consumed.unionByName(broken).unionByName(bad)
    found = {(r.id, r.diagnostic) for r in ln.diagnostics(links, members).collect()}
    stale = consumed.where("source_repo = 'r'").first()["id"]
    assert found == {("m", "malformed"), ("n", "malformed"), (stale, "stale")}
    orphan = broken.first()["id"]
    assert rows(ln.diagnostics(broken, members)) == [(orphan, "orphan")]
    assert [r.truncated for r in ln.listing(links, members, 4).collect()] == [True] * 4
    assert [r.truncated for r in ln.listing(links, members, 5).collect()] == [False] * 5
    assert ln.listing(links.limit(0), members).isEmpty()


def test_catalogue(spark, store):
    items = spark.createDataFrame([("c", "endpoint"), ("c", "endpoint"), ("c", "status")], "contract_id string, role string")
    assert {r.contract_id: r.n_endpoints for r in ln.catalogue(store[0], items).collect()} == {"c": 2, "d": 0}
