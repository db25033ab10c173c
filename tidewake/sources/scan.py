"""Inputs: file trees, git logs, observed traces, session transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.text import language, redact

#: Folders that are never scanned, the largest file, and the bytes of a sample.
SKIPPED = (
    ".git", "node_modules", "dist", "coverage", ".venv", "venv", "__pycache__", "site-packages", "target", "vendor", "build", ".tox", ".pytest_cache",
    ".mypy_cache", ".ruff_cache",
)
MOST_BYTES, SAMPLE_BYTES = 1_000_000, 4096
MOST_SESSION_CHARS = 200_000


def scan_files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(path, language, content, content_hash, skipped)`` of the files of known languages under ``root``.

    The size filter reaches the listing. Larger files are kept as skipped, with
    a sample of their first bytes for content.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace("path", "^.*?" + base.replace("file://", "").replace(".", r"\.") + "/", "")
    kept = found.withColumn("path", path).where(~F.col("path").rlike(r"(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    large = F.col("length") > most_bytes
    content = F.when(large, F.substring("content", 1, SAMPLE_BYTES)).otherwise(F.col("content"))
    return kept.select("path", language(F.col("path")).alias("language"), content.cast("string").alias("content"), F.sha2("content", 256).alias("content_hash"), large.alias("skipped")).where("language IS NOT NULL")


def parse_git_log(logs: DataFrame, column: str = "log") -> DataFrame:
    """``(commit, path)`` of logs whose commits are set apart by NUL and list a path per line."""
    chunks = logs.select(F.posexplode(F.split(column, "\x00")).alias("commit", "chunk"))
    paths = chunks.select("commit", F.explode(F.split("chunk", "\n")).alias("path")).withColumn("path", F.trim("path"))
    return paths.where("path <> ''")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """``(source, target)`` of a JSON array, or an object with ``edges``; entries without both ends are an error."""
    text = spark.read.text(path, wholetext=True)
    one = "array<struct<source:string,target:string>>"
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.edges"))
    edges = F.from_json(listed, one)
    rows = text.select(F.posexplode(edges).alias("at", "e")).select("at", "e.*")
    bad = F.raise_error(F.concat(F.lit("edge without source or target at "), F.col("at").cast("string")))
    return rows.select(F.when(F.col("source").isNull() | F.col("target").isNull(), bad).otherwise(F.col("source")).alias("source"), "target")


def session_facts(turns: DataFrame, known: DataFrame, most_files: int = 100) -> DataFrame:
    """``(conv_id, kind, value)``: a summary fact of each conversation and one per known file (path) that it names.

    Texts are redacted first. Path-like strings are matched with the known
    files by equality; a conversation's files count in order of name.
    """
    texts = turns.groupBy("conv_id").agg(
        F.substring(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["text"])), 1, MOST_SESSION_CHARS).alias("text"),
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "tool").alias("tools"),
    )
    clean = texts.withColumn("text", redact(F.col("text"), MOST_SESSION_CHARS))
    summary = clean.select("conv_id", F.lit("summary").alias("kind"), F.format_string("%d messages, %d tool calls", "messages", "tools").alias("value"))
    named = clean.select("conv_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w@.-]+(?:/[\w@.-]+)*\.[A-Za-z]\w*"), F.lit(0)))).alias("path"))
    files = named.join(known.select("path").distinct(), "path", "left_semi").groupBy("conv_id").agg(F.slice(F.sort_array(F.collect_set("path")), 1, most_files).alias("paths"))
    return summary.unionByName(files.select("conv_id", F.lit("file").alias("kind"), F.explode("paths").alias("value")))


def under(root: str, path: Column) -> Column:
    """The path if it stays inside ``root`` (no NUL, not absolute, never above it), else an error."""
    bad = path.contains("\x00") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    return F.when(bad, F.raise_error(F.concat(F.lit("path resolves outside the root: "), path))).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
