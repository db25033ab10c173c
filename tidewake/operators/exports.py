"""Renderings of graphs and impact results: Mermaid, DOT, SARIF, Markdown. One row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.confidence import rank
from tidewake.functions.text import escape_dot, shell_quote

#: SARIF's level for each confidence.
SARIF_LEVELS = {"proven": "error", "inferred": "warning", "heuristic": "note", "unknown": "note"}


def _joined(lines: DataFrame, head: str, tail: str = "") -> DataFrame:
    """``(text)`` of all lines in order. For exports: the graph is one that fits on a page."""
    body = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    return lines.agg(F.concat(F.lit(head), body, F.lit(tail)).alias("text"))


def dot(edges: DataFrame) -> DataFrame:
    """Graphviz text of (source_entity_id, target_entity_id, kind)."""
    line = F.concat(F.lit("  "), escape_dot(F.col("source_entity_id")), F.lit(" -> "), escape_dot(F.col("target_entity_id")), F.lit(" [label="), escape_dot(F.col("kind")), F.lit("];"))
    return _joined(edges.select(line.alias("line")), "digraph impact {\n", "\n}")


def _mermaid_node(c: Column) -> Column:
    label = F.replace(F.replace(c, F.lit('"'), F.lit("#quot;")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("n"), F.substring(F.sha1(c), 1, 8), F.lit('["'), label, F.lit('"]'))


def mermaid(edges: DataFrame) -> DataFrame:
    """Mermaid flowchart of (source_entity_id, target_entity_id, kind)."""
    line = F.concat(F.lit("  "), _mermaid_node(F.col("source_entity_id")), F.lit(" -->|"), F.col("kind"), F.lit("| "), _mermaid_node(F.col("target_entity_id")))
    return _joined(edges.select(line.alias("line")), "flowchart LR\n")


def sarif(affected: DataFrame) -> DataFrame:
    """SARIF 2.1.0 text of affected paths (seed, path, depth, confidence, kind); a rule for each confidence."""
    level = F.element_at(F.create_map(*[F.lit(x) for kv in SARIF_LEVELS.items() for x in kv]), F.col("confidence"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    message = F.format_string("%s is affected by %s at depth %d", "path", "seed", "depth")
    result = F.struct(
        F.concat(F.lit("impact/"), F.col("confidence")).alias("ruleId"),
        level.alias("level"),
        F.struct(message.alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct(F.sha2(F.concat_ws("|", "seed", "path", "kind"), 256).alias("impact/v1")).alias("partialFingerprints"),
    )
    rules = F.array(*[F.struct(F.lit(f"impact/{c}").alias("id")) for c in SARIF_LEVELS])
    tool = F.struct(F.struct(F.lit("tidewake").alias("name"), rules.alias("rules")).alias("driver"))
    rows = affected.agg(F.sort_array(F.collect_list(F.struct(-rank(F.col("confidence")), "depth", "path", "seed", result.alias("r")))).alias("all"))
    run = F.struct(tool.alias("tool"), F.transform("all", lambda x: x["r"]).alias("results"))
    return rows.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("text"))


def markdown(affected: DataFrame, most: int = 50) -> DataFrame:
    """A Markdown table of the first ``most`` affected paths, with the number of all."""
    top = affected.orderBy(rank(F.col("confidence")).desc(), "depth", "path", "seed").limit(most)
    line = F.format_string("| %s | %s | %d |", F.replace(F.col("path"), F.lit("|"), F.lit("\\|")), "confidence", "depth")
    key = F.struct((-rank(F.col("confidence"))).alias("r"), "depth", "path", "seed", line.alias("line"))
    body = top.agg(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["line"]).alias("lines"))
    total = affected.agg(F.count("*").alias("n"))
    text = F.concat(F.lit("# Impact\n\nAffected: "), F.col("n").cast("string"), F.lit("\n\n| path | confidence | depth |\n|-|-|-|\n"), F.array_join("lines", "\n"))
    return body.crossJoin(total).select(text.alias("text"))  # one row each


def verify_commands(affected: DataFrame) -> DataFrame:
    """Commands that run the affected JavaScript and TypeScript tests."""
    tests = affected.where(F.col("path").rlike(r"(\.|-)(test|spec)\.[cm]?[tj]sx?$")).select("path").distinct()
    return tests.select("path", F.concat(F.lit("npx vitest run "), shell_quote(F.col("path"))).alias("command"))


def blast_label(count: Column) -> Column:
    return F.when(count == 0, "clear").when(count <= 3, "contained").when(count <= 12, "expanding").otherwise("wide")
