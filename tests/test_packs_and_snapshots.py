import pytest
from pyspark.sql import functions as F

from tidewake.operators import packs
from tidewake.sources import snapshots as sn


def test_pack_order_limit_and_evidence(spark):
    hit = spark.createDataFrame(
        [("src/a.ts", 1, "proven"), ("a.test.ts", 1, "proven"), ("docs/a.md", 1, "proven"), ("c.json", 1, "proven"), ("z.ts", 1, "unknown"), ("y.ts", 2, "proven"), ("x.ts", 3, "proven")],
        "path string, depth int, confidence string",
    )
    got = packs.context_pack(hit, "brief").orderBy("place").collect()
    assert [r.path for r in got] == ["a.test.ts", "docs/a.md", "c.json", "src/a.ts", "z.ts"] and got[0].omitted == 2
    proof = spark.createDataFrame([("y.ts", "k", "t" * 400, "heuristic", None), ("y.ts", "k", "short", "proven", 3), ("q.ts", "k", "no", "proven", 1)], "path string, kind string, text string, confidence string, start_line int")
    found = packs.evidence_of(hit, proof, "brief").collect()
    assert [len(r.text) for r in found] == [5, 300]


def test_freshness(spark):
    rows = [("a", "proposal", "2024-01-01"), ("b", "decision", "2024-01-01"), ("c", "doc", "2024-13-01"), ("d", "doc", "2030-01-01"), ("e", "policy", None)]
    df = spark.createDataFrame(rows, "path string, kind string, updated_at string")
    out = {r.path: (r.age_days, r.freshness) for r in packs.freshness(df, F.to_date(F.lit("2024-04-10"))).collect()}
    assert out == {"a": (100, "stale"), "b": (100, "current"), "c": (None, "unknown"), "d": (0, "current"), "e": (None, "unknown")}
    twice = spark.createDataFrame([("p", "x", 2, "2024-01-01"), ("p", "x", 1, "2024-02-01")], "kind string, path string, depth int, updated_at string")
    assert tuple(packs.one_per_artifact(twice).first()) == ("p", "x", 1, "2024-02-01")


def test_a_run_counts_once_its_manifest_is_written(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = (spark.createDataFrame([(k,)], "n int") for k in (1, 2))
    with pytest.raises(ValueError, match="no committed run"):
        sn.read_run(spark, root, "files")
    sn.write_run(spark, root, 1, {"files": one}, version="v1")
    two.write.parquet(f"{root}/files/run=2")  # a run that failed before its manifest
    assert [tuple(r) for r in sn.read_run(spark, root, "files").collect()] == [(1, 1)]
    sn.write_run(spark, root, 2, {"files": two}, version="v1")
    assert [tuple(r) for r in sn.read_run(spark, root, "files").collect()] == [(2, 2)]
    assert sn.read_run(spark, root, "files", 1).first().n == 1
    with pytest.raises(ValueError, match="committed"):
        sn.write_run(spark, root, 2, {"files": two})
