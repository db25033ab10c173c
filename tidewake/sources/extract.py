"""Source files to symbols, imports, endpoints, test targets and package dependencies.

All of it is regular expressions and joins over ``files`` (path, language,
content), but for build manifests, which a parser per format reads.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.functions.text import basename, is_test

#: Patterns of declared symbols by language family: (languages, kind, pattern with one group).
SYMBOLS = (
    (("python",), "function", r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"),
    (("python",), "class", r"(?m)^[ \t]*class[ \t]+(\w+)"),
    (("go",), "function", r"(?m)^func[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)"),
    (("go",), "type", r"(?m)^type[ \t]+(\w+)"),
    (("rust",), "function", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|const[ \t]+|unsafe[ \t]+)*fn[ \t]+(\w+)"),
    (("rust",), "type", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:struct|enum|trait)[ \t]+(\w+)"),
    (("java", "kotlin", "csharp"), "type", r"\b(?:class|interface|enum|record|object)[ \t]+(\w+)"),
    (("kotlin",), "function", r"\bfun[ \t]+(?:<[^>]*>[ \t]*)?(?:\w+\.)?(\w+)[ \t]*\("),
    (("java", "csharp"), "method", r"(?m)^[ \t]*(?:public|protected|private|internal)[ \t]+(?:static[ \t]+|final[ \t]+|async[ \t]+|override[ \t]+)*[\w<>\[\], ?]+?[ \t]+(\w+)[ \t]*\("),
    (("c", "cpp"), "type", r"\b(?:struct|class|enum|union)[ \t]+(\w+)[ \t\n]*[{:]"),
    (("c", "cpp"), "function", r"(?m)^[A-Za-z_][\w \t*&:<>,]*?[ \t*&](\w+)[ \t]*\([^;{}]*\)[ \t\n]*\{"),
    (("typescript", "javascript"), "function", r"\bfunction[ \t]*\*?[ \t]+(\w+)"),
    (("typescript", "javascript"), "function", r"(?m)^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(\w+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^)\n]*\)|\w+)[^=\n]*=>"),
    (("typescript", "javascript"), "class", r"\bclass[ \t]+(\w+)"),
    (("typescript",), "interface", r"\b(?:interface|type|enum)[ \t]+(\w+)"),
)
#: Patterns of imports: (languages, pattern whose last group is the specifier).
IMPORTS = (
    (("python",), r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import"),
    (("python",), r"(?m)^[ \t]*import[ \t]+([\w.]+)"),
    (("go",), r'(?m)^[ \t]*(?:import[ \t]+)?(?:\w+[ \t]+)?"([^"\n]+)"[ \t]*$'),
    (("rust",), r"(?m)^[ \t]*(?:pub[ \t]+)?(?:use|mod)[ \t]+([\w:]+)"),
    (("java", "kotlin"), r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)"),
    (("csharp",), r"(?m)^[ \t]*using[ \t]+([\w.]+)[ \t]*;"),
    (("c", "cpp"), r'(?m)^[ \t]*#[ \t]*include[ \t]+[<"]([^>"\n]+)[>"]'),
    (("typescript", "javascript"), r"""(?:\bfrom|\bimport|\brequire[ \t]*\(|\bimport[ \t]*\()[ \t]*['"]([^'"\n]+)['"]"""),
    (("shell",), r"(?m)^[ \t]*(?:source|\.)[ \t]+([\w./-]+)"),
)
#: Endings that a relative specifier may lack, in order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rs", ".java", ".kt", ".h", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs")


def _each(files: DataFrame, rules, column: str, *extra):
    out = None
    for rule in rules:
        languages, pattern = rule[0], rule[-1]
        hits = files.where(F.col("language").isin(*languages)).select(
            "path", "language", *[e(rule) for e in extra], F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias(column)
        )
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def symbols(files: DataFrame) -> DataFrame:
    """``(path, language, kind, symbol)`` declared in files."""
    return _each(files, SYMBOLS, "symbol", lambda rule: F.lit(rule[1]).alias("kind"))


def imports(files: DataFrame) -> DataFrame:
    """``(path, language, specifier)``."""
    return _each(files, IMPORTS, "specifier")


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, specifier, target, confidence)``: the first known file among a specifier's candidates, else an external name.

    Candidates are made and joined with the paths by equality. Relative
    specifiers start at the importing file's folder, others at the root;
    dots of packages are folders.
    """
    folder = F.regexp_replace("path", r"[^/]*$", "")
    spec = F.col("specifier")
    plain = F.when(F.col("language").isin("python", "java", "kotlin"), F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/"))
    plain = plain.when(F.col("language") == "rust", F.regexp_replace(F.regexp_replace(spec, r"^(crate|self|super)::", ""), "::", "/")).otherwise(spec)
    local = F.concat(folder, F.regexp_replace(plain, r"^\./", ""))
    starts = F.when(spec.startswith("."), F.array(local)).otherwise(F.array(plain, local, F.concat(F.lit("src/"), plain)))
    up = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"[^/]+/\.\./", ""), r"[^/]+/\.\./", ""), r"[^/]+/\.\./", "")
    bare = lambda p: F.regexp_replace(p, r"\.(?:js|jsx|mjs|cjs)$", "")  # noqa: E731  a compiled name stands for its source
    candidates = F.flatten(F.transform(starts, lambda s: F.concat(F.array(up(s)), F.array(*[F.concat(bare(up(s)), F.lit(e)) for e in ENDINGS]))))
    tried = found.select("path", "specifier", F.posexplode(candidates).alias("at", "target"))
    known = files.select(F.col("path").alias("target")).distinct()
    hit = tried.join(known, "target").groupBy("path", "specifier").agg(F.min_by("target", "at").alias("target"))
    rows = found.select("path", "specifier").distinct().join(hit, ["path", "specifier"], "left")
    return rows.select(
        "path", "specifier", F.coalesce("target", F.concat(F.lit("external:"), spec)).alias("target"), F.when(F.col("target").isNull(), "heuristic").otherwise("proven").alias("confidence")
    )


def test_targets(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(path, target)``: what a test file verifies, by its imports and by its name without the test's mark."""
    tests = files.where(is_test(F.col("path"))).select("path", "language")
    by_import = resolved.where("confidence = 'proven'").join(tests.select("path"), "path", "left_semi").select("path", "target")
    stem = F.regexp_replace(F.regexp_replace(basename(F.col("path")), r"\.[^.]+$", ""), r"(?i)^test_|[._-]?(tests?|spec)$", "")
    sources = files.where(~is_test(F.col("path"))).select(F.col("path").alias("target"), "language", F.regexp_replace(basename(F.col("path")), r"\.[^.]+$", "").alias("stem"))
    by_name = tests.withColumn("stem", stem).join(sources, ["stem", "language"]).select("path", "target")
    return by_import.where(~is_test(F.col("target"))).unionByName(by_name).distinct()


def spring_endpoints(files: DataFrame) -> DataFrame:
    """``(path, endpoint)``: METHOD and path of mapped methods, for each base path of their class."""
    java = files.where(F.col("language").isin("java", "kotlin"))
    quoted = lambda c: F.regexp_extract_all(c, F.lit(r'"([^"]*)"'), F.lit(1))
    bases = quoted(F.regexp_extract("content", r"@RequestMapping\(([^)]*)\)[^{;]*\bclass\b", 1))
    mapped = java.select(
        "path",
        F.when(F.size(bases) > 0, bases).otherwise(F.array(F.lit(""))).alias("bases"),
        F.explode(F.regexp_extract_all("content", F.lit(r"@(?:Get|Post|Put|Delete|Patch)Mapping(?:\([^)]*\))?"), F.lit(0))).alias("m"),
    )
    own = quoted(F.col("m"))
    crossed = mapped.select("path", "m", F.explode("bases").alias("base"), F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(""))).alias("own")).select("path", "m", "base", F.explode("own").alias("sub"))
    route = F.regexp_replace(F.concat(F.lit("/"), F.col("base"), F.lit("/"), F.col("sub")), "/+", "/")
    route = F.when(F.char_length(route) > 1, F.regexp_replace(route, "/$", "")).otherwise(route)
    return crossed.select("path", F.concat_ws(" ", F.upper(F.regexp_extract("m", r"@(\w+)Mapping", 1)), route).alias("endpoint")).distinct()


# --- build manifests ---------------------------------------------------------


def _npm(text: str) -> Iterator[tuple[str, str, str]]:
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for name, version in (json.loads(text).get(section) or {}).items():
            yield section, name, "proven" if str(version).startswith(("workspace:", "file:")) else "heuristic"


def _go(text: str) -> Iterator[tuple[str, str, str]]:
    for block in re.findall(r"(?ms)^require\s*\((.*?)^\)", text):
        for name in re.findall(r"(?m)^\s*([\w./-]+)\s+v", block):
            yield "require", name, "heuristic"
    for name in re.findall(r"(?m)^require\s+([\w./-]+)\s+v", text):
        yield "require", name, "heuristic"


def _cargo(text: str) -> Iterator[tuple[str, str, str]]:
    for section in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, spec in (tomllib.loads(text).get(section) or {}).items():
            yield section, spec.get("package", name) if isinstance(spec, dict) else name, "proven" if isinstance(spec, dict) and "path" in spec else "heuristic"


def _python(text: str) -> Iterator[tuple[str, str, str]]:
    spec = tomllib.loads(text)
    project, poetry = spec.get("project") or {}, (spec.get("tool") or {}).get("poetry") or {}
    lists = [("dependencies", project.get("dependencies") or [])]
    lists += [(f"optional:{k}", v) for k, v in (project.get("optional-dependencies") or {}).items()]
    lists += [(f"group:{k}", [x for x in v if isinstance(x, str)]) for k, v in (spec.get("dependency-groups") or {}).items()]
    lists += [("poetry", [k for k in poetry.get("dependencies") or {} if k != "python"])]
    lists += [(f"poetry:{k}", list(g.get("dependencies") or {})) for k, g in (poetry.get("group") or {}).items()]
    for section, names in lists:
        for name in names:
            yield section, re.sub(r"[-_.]+", "-", re.split(r"[\s\[<>=!~;@(]", name, maxsplit=1)[0]).lower(), "heuristic"


def _maven(text: str) -> Iterator[tuple[str, str, str]]:
    root = ET.fromstring(text)
    space = re.match(r"\{.*\}", root.tag)
    ns = space[0] if space else ""
    known = {p.tag.removeprefix(ns): (p.text or "").strip() for p in root.findall(f"{ns}properties/*")}
    for tag in ("groupId", "artifactId", "version"):
        value = (root.findtext(f"{ns}{tag}") or root.findtext(f"{ns}parent/{ns}{tag}") or "").strip()
        known |= {f"project.{tag}": value, f"pom.{tag}": value}

    def filled(value: str, depth: int = 6) -> str:
        done = re.sub(r"\$\{([^}]*)\}", lambda m: known.get(m[1], m[0]), value)
        return done if done == value or not depth else filled(done, depth - 1)

    for d in root.findall(f"{ns}dependencies/{ns}dependency"):
        yield "dependencies", ":".join(filled((d.findtext(f"{ns}{t}") or "").strip()) for t in ("groupId", "artifactId")), "heuristic"


def _gradle(text: str) -> Iterator[tuple[str, str, str]]:
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    for section, name in re.findall(r"(\w+)\s*\(?\s*project\s*\(\s*(?:path\s*[:=]\s*)?['\"]:?([^'\"]+)['\"]", text):
        yield section, name, "proven"
    for section, name in re.findall(r"(?m)^\s*(\w*(?:mplementation|pi|ompileOnly|untimeOnly))\s*\(?\s*['\"]([\w.-]+:[\w.-]+)(?::[^'\"]*)?['\"]", text):
        yield section, name, "heuristic"


MANIFEST_PARSERS = {
    "package.json": _npm, "go.mod": _go, "Cargo.toml": _cargo, "pyproject.toml": _python, "pom.xml": _maven, "build.gradle": _gradle, "build.gradle.kts": _gradle,
}


def dependencies(files: DataFrame) -> DataFrame:
    """``(path, section, package, confidence)`` of build manifests; a malformed one gives a row of section ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, *d) for d in dict.fromkeys(MANIFEST_PARSERS[path.rsplit("/", 1)[-1]](text or ""))]
                except (ValueError, ET.ParseError, AttributeError, TypeError):
                    rows.append((path, "error", "", "unknown"))
            yield pd.DataFrame(rows, columns=["path", "section", "package", "confidence"])

    manifests = files.where(basename(F.col("path")).isin(*MANIFEST_PARSERS)).select("path", "content")
    return manifests.mapInPandas(run, "path string, section string, package string, confidence string")
