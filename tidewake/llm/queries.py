"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm._shared import LOWER, UPPER
from tidewake.llm.chat import CONTROL, format_examples, read_back
from tidewake.llm.embedding_dedup import embedding_links
from tidewake.llm.exact_dedup import mark_exact_duplicates
from tidewake.llm.langid import fit_languages, language_of
from tidewake.llm.line_dedup import drop_repeated_runs
from tidewake.llm.mixing import draws
from tidewake.llm.packing import pack
from tidewake.llm.pii import pseudonymise
from tidewake.llm.quality import fit_quality, quality_score
from tidewake.llm.sampling import held_out
from tidewake.llm.simhash import fingerprint_hex, near_duplicate_components

#: The file that op8 and the pipeline take their tokenizer from.
TOKENIZER = "byte_bpe_50k.json"
KEEP_QUALITY = 0.3
#: The setting that holds the key of pseudonyms, and the key of trials, which is used with a warning where it is unset.
PII_SETTING, TRIAL_KEY = "spark.tidewake.pii.key", "not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_exact_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    model = fit_quality(
        labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")),
        docs.select(F.col("doc_id").alias("id"), "text"),
    )
    return docs.select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), quality_score(F.col("text"), model, spark).alias("score")
    ).withColumn("predicted", (F.col("score") >= KEEP_QUALITY).cast("int"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = draws(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return drawn.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.aggregate("mix_draws", F.lit(0).cast("long"), lambda sum, d: sum + d["words"]).alias("taken"),
        F.transform("mix_draws", lambda d: d["shard"]).alias("shards"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    return read_back(format_examples(rows.unionByName(more)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.aggregate("ld_deleted", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"]).alias("n_deleted"),
        F.array_join(F.transform("ld_deleted", lambda r: F.concat_ws("-", r["first"].cast("string"), r["end"].cast("string"))), ",").alias("deleted"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_SETTING, None)
    if not key:
        warnings.warn(f"{PII_SETTING} is unset: these pseudonyms can be undone by anyone who reads the source", stacklevel=2)
    out = pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key or TRIAL_KEY)
    return out.select("doc_id", "text", F.size("pii_found").cast("long").alias("n_replaced"), F.col("pii_found").alias("replaced"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull())
    model = fit_languages(learn.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"))
    out = docs.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), language_of(F.col("text"), model, spark).alias("of")
    )
    return out.select("doc_id", "held_out", "of.lang_pred", "of.score", "of.accepted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality": op2_quality,
        "op3_mixing": op3_mixing,
        "op4_chat": op4_chat,
        "op5_line_dedup": op5_line_dedup,
        "op6_pii": op6_pii,
        "op7_language": op7_language,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_embedding_dedup": op10_embedding_dedup,
    }


_OP1 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
     g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id,
                  count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def _escaped_length(column: str) -> str:
    """Length of a text after escaping: one more for each backslash and each control string."""
    more = [f"length({column}) - length(replace({column}, '\\', ''))"]
    more += [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROL]
    return f"length({column}) + {' + '.join(more)}"


_OP4 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     l AS (SELECT *, 23 + {_escaped_length("role")} + {_escaped_length("text")} AS chars,
                  row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM r
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
     s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM l)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op4_chat": _OP4}
