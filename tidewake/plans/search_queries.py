"""Queries of retrieval, vectors, text and incremental indexing, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.functions import vectors as vec
from tidewake.operators import delta as dl
from tidewake.operators import search as se
from tidewake.plans.graph_views import table

_WORDS = "licensed license"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("model"), vec.quantise(F.col("embedding")).alias("vector")
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def bm25_documents(spark, sf_dir):
    out = se.bm25(_docs(spark, sf_dir), _WORDS, 50)
    return _rounded(out, "score").select("id", "score", F.col("rank").cast("long").alias("rank"))


def like_documents(spark, sf_dir):
    hits = _docs(spark, sf_dir).where(F.lower("text").contains("licensed under")).select("id", (-F.char_length("text")).alias("score"))
    return se.ranked(hits, 100).select("id", F.col("rank").cast("long").alias("rank"))


def quantised_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vector"))


def vector_nearest(spark, sf_dir):
    """The ten nearest of its label for every vector whose id is divisible by 20."""
    rows = _vectors(spark, sf_dir)
    out = vec.nearest(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query"), 10)
    return out.select("query", "id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def _streams(spark, sf_dir) -> dict[str, DataFrame]:
    near = vector_nearest(spark, sf_dir)
    return {
        "keyword": bm25_documents(spark, sf_dir),
        "like": like_documents(spark, sf_dir),
        "vector": near.groupBy("id").agg(F.min("rank").alias("rank")),
    }


def hybrid_search(spark, sf_dir):
    out = se.fuse(_streams(spark, sf_dir))
    return out.select("id", "score", F.col("rank").cast("long").alias("rank"), "reasons")


def diversified_search(spark, sf_dir):
    """The fused results of documents, taken in turn from their sources, within a byte budget."""
    docs = _docs(spark, sf_dir).select("id", "source", F.octet_length(tx.snippet(F.col("text"))).alias("bytes"))  # no text is shuffled
    fused = se.fuse(_streams(spark, sf_dir)).join(docs, "id")
    out = se.within_budget(se.diversify(fused, "source", 20), "bytes", 3000)
    return out.select("id", "source", F.col("place").cast("long").alias("place"), F.col("total").cast("long").alias("total"))


def retrieval_metrics(spark, sf_dir):
    """How well the keyword stream finds documents of good quality; one query."""
    returned = bm25_documents(spark, sf_dir).withColumn("query", F.lit("license"))
    relevant = table(spark, sf_dir, "labels").where("quality = 1").select(F.lit("license").alias("query"), F.col("doc_id").alias("id"))
    return se.ranking_metrics(returned, relevant)


def redacted_documents(spark, sf_dir):
    """Snippets of documents with a secret of each known form planted by rule."""
    planted = F.concat(F.substring("text", 1, 100), F.lit(" sk-"), F.sha1("text"), F.lit(" Bearer "), F.sha1("text"), F.lit(" redis://u:p@h "), F.col("text"))
    return _docs(spark, sf_dir).select("id", tx.redact(planted).alias("snippet"))


def document_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "id", tx.bytes_to_tokens(F.col("text")).cast("long").alias("tokens"), tx.snippet(F.col("text"), 80).alias("snippet"), F.octet_length("text").cast("long").alias("bytes")
    )


def document_mentions(spark, sf_dir):
    """How many documents mention a word of the benchmark as a whole word, and the first of them."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("name")).distinct()
    found = tx.mentions(_docs(spark, sf_dir).select("id", "text"), names)
    return found.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def path_kinds(spark, sf_dir):
    """Entity kind and language of paths made of documents and file names of every class."""
    names = [
        "src/a.ts", "tests/b.py", "x_test.go", "docs/adr/001.md", "rfc-2.md", "docs/prd/x.md", "requirements.md", "policy/p.md", "README.md",
        ".github/workflows/ci.yml", "api/openapi.yaml", "Dockerfile", "main.tf", "go.mod", "a.proto", "conf.toml", "Makefile", "CODEOWNERS", "a.b.spec.tsx", "none",
    ]
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names)).cast("int") + 1)
    path = F.concat(F.col("source"), F.lit("/"), pick)
    rows = _docs(spark, sf_dir).select(pick.alias("name"), path.alias("path"))
    return rows.groupBy("name").agg(
        F.max(tx.entity_kind(F.col("path"))).alias("kind"), F.max(F.coalesce(tx.language(F.col("path")), F.lit("-"))).alias("language"), F.count("*").alias("n")
    )


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _docs(spark, sf_dir).select(F.concat(F.lit("doc/"), F.col("id").cast("string")).alias("path"), F.sha2(F.col("text"), 256).alias("content_hash"), "id")
    before = rows.where("id % 17 <> 0").select("path", "content_hash")
    after = rows.where("id % 19 <> 0").select("path", F.when(F.col("id") % 23 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return before, after


def index_delta(spark, sf_dir):
    return dl.file_delta(*_snapshots(spark, sf_dir))


def index_mode(spark, sf_dir):
    changes = dl.file_delta(*_snapshots(spark, sf_dir))
    one = dl.index_mode(changes, "v1", "v1")
    same = dl.index_mode(changes.where("change IN ('changed', 'unchanged')"), "v1", "v1")
    new = dl.index_mode(changes, "v1", "v2")
    return one.unionByName(same).unionByName(new)


def carry_forward(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    changes = dl.file_delta(before, after)
    fresh = after.join(changes.where("change IN ('added', 'changed')"), "path", "left_semi")
    return dl.carry_forward(before, changes, fresh, 2).select("path", "content_hash", F.col("index_run_id").cast("long").alias("index_run_id"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_documents, like_documents, quantised_vectors, vector_nearest, hybrid_search, diversified_search, retrieval_metrics,
        redacted_documents, document_tokens, document_mentions, path_kinds, index_delta, index_mode, carry_forward,
    )
}

_BM25 = """tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
  cnt AS (SELECT id, len(t) AS dl, len([x for x in t if starts_with(x, 'licensed')]) AS f0, len([x for x in t if starts_with(x, 'license')]) AS f1 FROM tok),
  tot AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM cnt),
  sco AS (SELECT id, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a))
                   + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM cnt, tot WHERE f0 > 0 AND f1 > 0),
  bm AS (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sco QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 50)"""
_LIKE = """lk AS (SELECT doc_id AS id, row_number() OVER (ORDER BY length(text), doc_id) AS rank FROM documents WHERE contains(lower(text), 'licensed under')
  QUALIFY row_number() OVER (ORDER BY length(text), doc_id) <= 100)"""
_NEAR = """qv AS (SELECT vec_id AS id, label, [CAST(floor(least(greatest(CAST(x AS DOUBLE), -1.0), 1.0) * 127 + 0.5) AS INTEGER) for x in embedding] AS v FROM embeddings),
  qs AS (SELECT label, id AS query, v AS q FROM qv WHERE id % 20 = 0),
  nn AS (SELECT query, id, CAST(list_sum([v[i] * q[i] for i in range(1, 65)]) AS BIGINT) AS score FROM qv JOIN qs USING (label)),
  nr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM nn QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10)"""
_FUSED = f"""{_BM25}, {_LIKE}, {_NEAR},
  al AS (SELECT id, 'keyword' AS s, rank FROM bm UNION ALL SELECT id, 'like', rank FROM lk UNION ALL SELECT id, 'vector', min(rank) FROM nr GROUP BY id),
  fu AS (SELECT id, round(sum(1.0 / (60 + rank)), 8) AS score, string_agg(s, ',' ORDER BY s) AS reasons FROM al GROUP BY id),
  fr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, reasons FROM fu)"""
_SNAP = """sn AS (SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h, doc_id AS id FROM documents),
  bf AS (SELECT path, h FROM sn WHERE id % 17 <> 0),
  af AS (SELECT path, CASE WHEN id % 23 = 0 THEN sha256(h) ELSE h END AS h FROM sn WHERE id % 19 <> 0),
  de AS (SELECT path, CASE WHEN bf.h IS NULL THEN 'added' WHEN af.h IS NULL THEN 'deleted' WHEN bf.h <> af.h THEN 'changed' ELSE 'unchanged' END AS change FROM bf FULL JOIN af USING (path))"""
_PLANT = "left(text, 100) || ' [REDACTED_OPENAI_KEY] Bearer [REDACTED_BEARER_TOKEN] [REDACTED_DB_URL] ' || text"
ORACLES = {
    "bm25_documents": f"WITH {_BM25} SELECT * FROM bm",
    "like_documents": f"WITH {_LIKE} SELECT * FROM lk",
    "quantised_vectors": f"WITH {_NEAR} SELECT id, array_to_string(v, ',') AS vector FROM qv",
    "vector_nearest": f"WITH {_NEAR} SELECT query, id, score, rank FROM nr",
    "hybrid_search": f"WITH {_FUSED} SELECT * FROM fr",
    "diversified_search": f"""WITH {_FUSED}, dv AS (SELECT fr.id, source, rank, octet_length(encode(CASE WHEN length(text) > 240 THEN left(text, 237) || '...' ELSE text END)) AS bytes,
      row_number() OVER (PARTITION BY source ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY source) AS first FROM fr JOIN documents ON doc_id = fr.id),
      pl AS (SELECT *, row_number() OVER (ORDER BY turn, first, rank) AS place FROM dv QUALIFY row_number() OVER (ORDER BY turn, first, rank) <= 20),
      su AS (SELECT id, source, place, CAST(sum(bytes) OVER (ORDER BY place) AS BIGINT) AS total FROM pl) SELECT * FROM su WHERE total <= 3000""",
    "retrieval_metrics": f"""WITH {_BM25}, re AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1), hi AS (SELECT rank FROM bm WHERE id IN (SELECT id FROM re)),
      g AS (SELECT (SELECT count(*) FROM re) AS total, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, min(rank) AS first,
                   coalesce(sum(1 / log2(rank + 1.0)) FILTER (WHERE rank <= 10), 0) AS dcg FROM hi)
      SELECT 'license' AS query, round(h5 / total, 6) AS recall_5, round(h10 / total, 6) AS recall_10, round(h5 / 5, 6) AS precision_5, round(coalesce(1 / first, 0), 6) AS mrr,
             round(dcg / (SELECT sum(1 / log2(i + 2.0)) FROM range(CAST(least(total, 10) AS BIGINT)) r(i)), 6) AS ndcg_10 FROM g""",
    "document_tokens": "SELECT doc_id AS id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens, "
    "CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS snippet, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
    "redacted_documents": f"SELECT doc_id AS id, CASE WHEN length(p) > 500 THEN left(p, 500) || '...[TRUNCATED]' ELSE p END AS snippet FROM (SELECT doc_id, {_PLANT} AS p FROM documents)",
    "document_mentions": "WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS name FROM benchmark), "
    "w AS (SELECT name FROM n WHERE length(name) >= 4), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS name FROM documents) "
    "SELECT name, count(*) AS n, min(doc_id) AS first FROM d JOIN w USING (name) GROUP BY name",
    "path_kinds": "WITH p(k, name, kind, language) AS (VALUES (0, 'src/a.ts', 'file', 'typescript'), (1, 'tests/b.py', 'test', 'python'), (2, 'x_test.go', 'test', 'go'), "
    "(3, 'docs/adr/001.md', 'decision', 'markdown'), (4, 'rfc-2.md', 'proposal', 'markdown'), (5, 'docs/prd/x.md', 'prd', 'markdown'), (6, 'requirements.md', 'requirement', 'markdown'), "
    "(7, 'policy/p.md', 'policy', 'markdown'), (8, 'README.md', 'doc', 'markdown'), (9, '.github/workflows/ci.yml', 'config', 'yaml'), (10, 'api/openapi.yaml', 'contract', 'yaml'), "
    "(11, 'Dockerfile', 'resource', 'dockerfile'), (12, 'main.tf', 'resource', 'terraform'), (13, 'go.mod', 'config', 'go'), (14, 'a.proto', 'contract', 'protobuf'), "
    "(15, 'conf.toml', 'config', 'toml'), (16, 'Makefile', 'config', 'makefile'), (17, 'CODEOWNERS', 'policy', 'policy'), (18, 'a.b.spec.tsx', 'test', 'typescript'), (19, 'none', 'file', '-')) "
    "SELECT name, kind, language, count(*) AS n FROM documents JOIN p ON doc_id % 20 = k GROUP BY ALL",
    "index_delta": f"WITH {_SNAP} SELECT * FROM de",
    "index_mode": f"""WITH {_SNAP}, c AS (SELECT count(*) FILTER (WHERE change = 'added') AS a, count(*) FILTER (WHERE change = 'changed') AS n_changed, count(*) FILTER (WHERE change = 'unchanged') AS n_unchanged FROM de)
      SELECT CASE WHEN a > 0 THEN 'full' ELSE 'incremental' END AS mode, CASE WHEN a > 0 THEN 'files added' END AS reason, n_changed, n_unchanged FROM c
      UNION ALL SELECT 'incremental', NULL, n_changed, n_unchanged FROM c UNION ALL SELECT 'full', 'extractor changed', n_changed, n_unchanged FROM c""",
    "carry_forward": f"WITH {_SNAP} SELECT path, coalesce(af.h, bf.h) AS content_hash, CAST(2 AS BIGINT) AS index_run_id FROM de LEFT JOIN bf USING (path) LEFT JOIN af USING (path) WHERE change <> 'deleted'",
}
