from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.functions import vectors as vec
from tidewake.operators import delta as dl
from tidewake.operators import search as se
from tidewake.sources import extract as ex
from tidewake.sources import scan


def values(spark, items, f):
    rows = spark.createDataFrame(list(enumerate(items)), "i int, t string").select("i", f(F.col("t")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_redaction_of_every_form(spark):
    raw = {
        "k": "sk-" + "a" * 24, "s": "sk_live_" + "b" * 24, "g": "ghp_" + "c" * 24, "x": "xoxb-" + "1" * 24, "a": "AKIA" + "Z" * 16, "n": "npm_" + "d" * 36,
        "j": "eyJhbGci.eyJzdWIi.c2ln", "b": "Bearer " + "e" * 30, "d": "postgres://u:pw@host/db", "p": "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
        "i": "AIza" + "f" * 35, "w": "AWS_SECRET_ACCESS_KEY = " + "g" * 40,
    }
    out = values(spark, list(raw.values()), tx.redact)
    for old, new in zip(raw.values(), out, strict=True):
        assert "[REDACTED_" in new and old.split(" ")[-1] not in new
    clean, long, cut = values(spark, ["nothing here", "a" * 600, "a" * 490 + raw["p"] + "b" * 90], tx.redact)
    assert clean == "nothing here" and long == "a" * 500 + "...[TRUNCATED]"
    assert cut == "a" * 490 + "[REDACTED_PRIVATE_KEY]...[TRUNCATED]"


def test_scalars(spark):
    assert values(spark, ["a b", "plain.ts", "it's"], tx.shell_quote) == ["'a b'", "plain.ts", "'it'\\''s'"]
    assert values(spark, ["userName", "HTTPServer"], tx.camel_to_snake) == ["user_name", "http_server"]
    assert values(spark, ["a b/c"], tx.percent_encode) == ["a%20b%2Fc"]
    assert values(spark, ["security.md", "docs/policies/x.md", "a-decision.md"], tx.entity_kind) == ["policy", "policy", "decision"]
    assert values(spark, [".github/workflows/ci.yml"], tx.entity_kind) == ["workflow"]
    one = spark.range(1).select(vec.quantise(F.array(F.lit(0.5), F.lit(-0.5), F.lit(2.0))).alias("q"), vec.dot(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("d")).first()
    assert list(one.q) == [64, -63, 127] and one.d == 3.0
    stub = spark.range(1).select(vec.stub_embedding(F.lit("x")).alias("v")).first().v
    assert len(stub) == 768 and all(-128 <= x <= 127 for x in stub)


def test_search_terms_and_fusion(spark):
    assert se.query_terms("a/b") is None and se.query_terms("Rotate Nonce") == ["rotate", "nonce"]
    docs = spark.createDataFrame([("p", "rotating credential validator rejects stale nonce during handoff"), ("q", "checkout retry owner escalation policy"), ("r", "credential store")], "id string, text string")
    assert [r.id for r in se.bm25(docs, "credential nonce validator").collect()] == ["p"]
    assert [r.id for r in se.bm25(docs, "checkout retry policy").collect()] == ["q"]
    a, b = (spark.createDataFrame(x, "id string, rank int") for x in ([("p", 1), ("q", 2)], [("q", 1)]))
    fused = se.fuse({"a": a, "b": b})
    assert [(r.id, r.reasons) for r in fused.collect()] == [("q", "a,b"), ("p", "a")]
    ranked = spark.createDataFrame([(i, i, "xxxy"[i % 4]) for i in range(1, 8)], "id int, rank int, k string")
    assert [r.id for r in se.diversify(ranked, "k", 4).orderBy("place").collect()] == [1, 3, 2, 7]
    got = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 9, 3)], "query string, id int, rank int")
    want = spark.createDataFrame([("q", 1), ("q", 9)], "query string, id int")
    m = se.ranking_metrics(got, want).first()
    assert (m.recall_5, m.precision_5, m.mrr, m.ndcg_10) == (1.0, 0.4, 1.0, 0.919721)


def test_fusion_keeps_every_row_of_its_streams(spark):
    n = 2 * se.STREAM_ROWS + 300  # more than STREAM_ROWS of each stream
    long = spark.range(n).selectExpr("id", "CAST(id % 10 + 1 AS INT) AS rank")
    other = spark.createDataFrame([(n - 1, 1), (n + 5, 2)], "id long, rank int")
    got = se.fuse({"long": long, "other": other}).orderBy("rank").collect()
    score = {i: round(1 / (61 + i % 10), 8) for i in range(n)} | {n + 5: round(1 / 62, 8)}
    score[n - 1] = round(1 / (61 + (n - 1) % 10) + 1 / 61, 8)
    want = sorted(score, key=lambda i: (-score[i], i))
    assert [(r.id, r["rank"], r.score) for r in got] == [(i, k, score[i]) for k, i in enumerate(want, start=1)]
    empty = se.fuse({"a": long.limit(0), "b": long.limit(0)})
    assert empty.count() == 0


def test_delta_modes(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    before, same, edit, more = files([("a", "1"), ("b", "2")]), files([("a", "1"), ("b", "2")]), files([("a", "1"), ("b", "3")]), files([("a", "1"), ("b", "2"), ("c", "4")])
    mode = lambda after, old="v": tuple(dl.index_mode(dl.file_delta(before, after), old, "v").first())
    assert mode(edit) == ("incremental", None, 1, 1) and mode(more)[:2] == ("full", "files added")
    assert mode(same, None)[:2] == ("full", "no prior run") and mode(same, "u")[:2] == ("full", "extractor changed")
    new = files([("a", "9")])
    assert sorted(map(tuple, dl.upsert(before, new, ["path"]).collect())) == [("a", "9"), ("b", "2")]
    assert sorted(map(tuple, dl.upsert(before, new, ["path"], True).collect())) == [("a", "1"), ("b", "2")]


SOURCES = [
    ("src/alpha.ts", "typescript", "import { b } from './beta'\nimport x from 'lib'\nexport function run() {}\nconst go = async (a) => a\nclass K {}"),
    ("src/beta.ts", "typescript", "export interface B {}"),
    ("tests/alpha.test.ts", "typescript", "import '../src/alpha.js'"),
    ("pkg/mod.py", "python", "from pkg.util import f\nimport os\nclass C:\n    async def m(self): pass"),
    ("pkg/util.py", "python", "def f(): pass"),
    ("go/a.go", "go", 'import "fmt"\nfunc (s *S) Do() {}\ntype S struct {}'),
    ("A.java", "java", '@RequestMapping({"/api", "/v2"})\npublic class A {\n @GetMapping("/x")\n public String get() { return ""; }\n @PostMapping\n public void put() {}\n}'),
]


def test_extraction(spark):
    files = spark.createDataFrame(SOURCES, "path string, language string, content string")
    found = {(r.path, r.kind, r.symbol) for r in ex.symbols(files).collect()}
    assert {("src/alpha.ts", "function", "run"), ("src/alpha.ts", "function", "go"), ("src/alpha.ts", "class", "K"), ("pkg/mod.py", "function", "m"), ("go/a.go", "function", "Do"), ("go/a.go", "type", "S"), ("A.java", "type", "A"), ("A.java", "method", "get")} <= found
    resolved = ex.resolve_imports(ex.imports(files), files)
    got = {(r.path, r.target, r.confidence) for r in resolved.collect()}
    assert {("src/alpha.ts", "src/beta.ts", "proven"), ("src/alpha.ts", "external:lib", "heuristic"), ("tests/alpha.test.ts", "src/alpha.ts", "proven"), ("pkg/mod.py", "pkg/util.py", "proven"), ("go/a.go", "external:fmt", "heuristic")} <= got
    assert {(r.path, r.target) for r in ex.test_targets(files, resolved).collect()} == {("tests/alpha.test.ts", "src/alpha.ts")}
    assert {r.endpoint for r in ex.spring_endpoints(files).collect()} == {"GET /api/x", "GET /v2/x", "POST /api", "POST /v2"}


def test_manifests(spark):
    rows = [
        ("package.json", '{"dependencies": {"a": "workspace:*", "b": "1"}}'), ("go.mod", "module m\nrequire (\n\tgithub.com/x/y v1.2.3\n)\nrequire z.org/q v0.1.0\n"),
        ("Cargo.toml", '[dependencies]\nserde = "1"\nmine = { path = "../mine" }'), ("pyproject.toml", '[project]\ndependencies = ["Foo_Bar>=1", "x[y]~=2"]'),
        ("pom.xml", "<project><groupId>g</groupId><dependencies><dependency><groupId>${project.groupId}</groupId><artifactId>k</artifactId></dependency></dependencies></project>"),
        ("build.gradle", "dependencies { implementation project(':core')\n implementation 'a.b:c:1' }"), ("sub/package.json", "{"),
    ]
    got = {(r.path, r.package, r.confidence) for r in ex.dependencies(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {
        ("package.json", "a", "proven"), ("package.json", "b", "heuristic"), ("go.mod", "github.com/x/y", "heuristic"), ("go.mod", "z.org/q", "heuristic"),
        ("Cargo.toml", "serde", "heuristic"), ("Cargo.toml", "mine", "proven"), ("pyproject.toml", "foo-bar", "heuristic"), ("pyproject.toml", "x", "heuristic"),
        ("pom.xml", "g:k", "heuristic"), ("build.gradle", "core", "proven"), ("build.gradle", "a.b:c", "heuristic"), ("sub/package.json", "", "unknown"),
    }


def test_scan_logs_traces_and_sessions(spark, tmp_path):
    for name, body in (("src/a.ts", "x"), ("node_modules/b.ts", "x"), ("c.unknown", "x"), ("big.py", "y" * 5000)):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    got = {r.path: (r.language, r.skipped, len(r.content)) for r in scan.scan_files(spark, str(tmp_path), 4500).collect()}
    assert got == {"src/a.ts": ("typescript", False, 1), "big.py": ("python", True, 4096)}
    log = spark.createDataFrame([("\x00\na.ts\nb.ts\n\x00\n\n\x00c.ts",)], "log string")
    assert {(r.commit, r.path) for r in scan.parse_git_log(log).collect()} == {(1, "a.ts"), (1, "b.ts"), (3, "c.ts")}
    (tmp_path / "t.json").write_text('{"edges": [{"source": "a", "target": "b"}]}')
    assert [tuple(r) for r in scan.read_traces(spark, str(tmp_path / "t.json")).collect()] == [("a", "b")]
    turns = spark.createDataFrame([(1, 0, "user", "see src/a.ts and no/b.ts"), (1, 1, "tool", "ok")], "conv_id long, turn long, role string, text string")
    facts = scan.session_facts(turns, spark.createDataFrame([("src/a.ts",)], "path string"))
    assert {(r.kind, r.value) for r in facts.collect()} == {("summary", "2 messages, 1 tool calls"), ("file", "src/a.ts")}
