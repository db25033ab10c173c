import hashlib

from pyspark.sql import functions as F

from tidewake.llm.exact_dedup import drop_exact_duplicates, mark_exact_duplicates

ROWS = [
    (1, "Hello World", "x"), (2, "hello world", "y"), (3, "HELLO WORLD", "z"), (4, "hello  world", None),
    (5, None, "a"), (6, "", "b"), (7, "É", None), (8, "é", None), (9, "É", "q"), (None, "hello world", "n"), (None, "alone", "n"),
    (3, "HELLO WORLD", "z"), (10, "x" * 200_000, None), (11, "X" * 200_000, None),
]
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def expected(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t, _ in rows:
        n = (t or "").translate(LOWER)
        keep = max((k for k in groups[n] if k is not None), default=None)
        out.append((i, keep, len(groups[n]), keep == i, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def marks(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_marks_match_brute_force_with_clashing_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n string").withColumn("kept", F.lit("clash")).withColumn("h", F.lit(1))
    assert marks(mark_exact_duplicates(docs)) == expected(ROWS)


def test_collisions_of_the_hash_are_told_apart_by_bytes(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n string")
    assert marks(mark_exact_duplicates(docs, digest=lambda c: F.substring(F.md5(c), 1, 1))) == expected(ROWS)


def test_drop_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n string")
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    texts = [(r.text or "").translate(LOWER) for r in out.collect()]
    assert sorted(texts) == sorted({(t or "").translate(LOWER) for _, t, _ in ROWS})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert mark_exact_duplicates(docs).count() == drop_exact_duplicates(docs).count() == 0
