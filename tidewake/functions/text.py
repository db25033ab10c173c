"""Text functions: secrets, paths, mentions, snippets, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of secrets, in order, and what replaces them.
SECRETS: tuple[tuple[str, str], ...] = (
    (r"sk-[A-Za-z0-9_-]{20,}", "[REDACTED_OPENAI_KEY]"),
    (r"sk_(?:live|test)_[A-Za-z0-9]{20,}", "[REDACTED_STRIPE_KEY]"),
    (r"rk_(?:live|test)_[A-Za-z0-9]{20,}", "[REDACTED_STRIPE_KEY]"),
    (r"gh[opsru]_[A-Za-z0-9_]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"github_pat_[A-Za-z0-9_]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"xox[baprs]-[A-Za-z0-9-]{20,}", "[REDACTED_SLACK_TOKEN]"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED_AWS_ACCESS_KEY]"),
    (r"AWS_SECRET_ACCESS_KEY\s*=\s*[A-Za-z0-9/+=]{32,}", "AWS_SECRET_ACCESS_KEY=[REDACTED_AWS_SECRET_ACCESS_KEY]"),
    (r"AIza[0-9A-Za-z_-]{35}", "[REDACTED_GOOGLE_API_KEY]"),
    (r"npm_[A-Za-z0-9]{36}", "[REDACTED_NPM_TOKEN]"),
    (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED_JWT]"),
    (r"Bearer\s+[A-Za-z0-9._~+/=-]{24,}", "Bearer [REDACTED_BEARER_TOKEN]"),
    (r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s:@/]+:[^\s@/]+@[^\s/]+", "[REDACTED_DB_URL]"),
    (
        r"(?s)-----BEGIN (?:RSA |OPENSSH |EC |DSA |)?PRIVATE KEY-----.*?-----END (?:RSA |OPENSSH |EC |DSA |)?PRIVATE KEY-----",
        "[REDACTED_PRIVATE_KEY]",
    ),
)
TRUNCATED = "...[TRUNCATED]"

#: Language of file names, and of extensions.
LANGUAGE_BY_NAME = {
    "Dockerfile": "dockerfile", "Containerfile": "dockerfile", "Makefile": "makefile", "CODEOWNERS": "policy", "package.json": "json",
    "pnpm-workspace.yaml": "yaml", "pom.xml": "xml", "settings.gradle": "gradle", "settings.gradle.kts": "gradle", "build.gradle": "gradle",
    "build.gradle.kts": "gradle", "go.mod": "go", "go.work": "go", "Cargo.toml": "toml", "pyproject.toml": "toml",
}
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "md": "markdown",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp",
    "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "sh": "shell", "bash": "shell", "zsh": "shell", "yaml": "yaml", "yml": "yaml",
    "json": "json", "toml": "toml", "properties": "properties", "tf": "terraform", "proto": "protobuf", "graphql": "graphql", "gql": "graphql", "gradle": "gradle",
}
#: Languages of configuration, and names of build manifests.
CONFIG_LANGUAGES = ("yaml", "json", "toml", "properties", "shell", "makefile", "gradle", "xml")
MANIFESTS = (
    "package.json", "pnpm-workspace.yaml", "pom.xml", "settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts",
    "go.mod", "go.work", "Cargo.toml", "pyproject.toml",
)
#: Names of policy documents.
POLICY_NAMES = ("security.md", "security-policy.md", "compliance.md", "privacy.md")
#: Patterns of test files by path, then by name.
TEST_PATHS = (r"(^|/)(tests?|__tests__)/|(^|/)src/test/",)
TEST_NAMES = (
    r"(\.|-)(test|spec)\.[cm]?[tj]sx?$", r"(?:Test|Tests|Spec)\.(?:java|kt)$", r"(?:^test_.*|.*_test)\.py$", r"_test\.go$", r"(?:_test|_spec)\.rs$",
)


def redact(text: Column, most: int = 500) -> Column:
    """Secrets replaced, then cut to ``most`` characters; a marker that would be cut is kept whole."""
    out = text
    for pattern, marker in SECRETS:
        out = F.regexp_replace(out, pattern, marker.replace("$", r"\$"))
    head = F.substring(out, 1, most)
    opened = F.regexp_extract(head, r"(?s)^.*(\[REDACTED_[^\]]*)$", 1)  # a marker still open at the cut
    rest = F.substring_index(F.substring(out, F.lit(most + 1), F.char_length(out)), "]", 1)
    closed = F.when(opened != "", F.concat(head, rest, F.lit("]"))).otherwise(head)
    return F.when(F.char_length(out) > most, F.concat(closed, F.lit(TRUNCATED))).otherwise(out)


def snippet(text: Column, most: int = 240) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _lookup(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)


def language(path: Column) -> Column:
    """Language of a path by its file name, then by its extension; null if unknown."""
    name = basename(path)
    extension = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    return F.coalesce(_lookup(name, LANGUAGE_BY_NAME), _lookup(extension, LANGUAGE_BY_EXTENSION))


def is_test(path: Column) -> Column:
    out = F.lit(False)
    for p in TEST_PATHS:
        out = out | path.rlike(p)
    for p in TEST_NAMES:
        out = out | basename(path).rlike(p)
    return out


def markdown_kind(path: Column) -> Column:
    """Kind of a document by folders and words of its name, the first that fits."""
    low = F.lower(path)
    stem = F.regexp_replace(basename(low), r"\.mdx?$", "")
    folder = lambda names: low.rlike(rf"(^|/)({names})/")
    word = lambda names: stem.rlike(rf"(^|[^a-z0-9])({names})([^a-z0-9]|$)")
    return (
        F.when(folder("decisions?|adrs?") | stem.rlike("^adr[-_0-9]") | word("decision"), "decision")
        .when(folder("proposals?|rfcs?") | stem.rlike("^rfc[-_0-9]") | word("proposal"), "proposal")
        .when(folder("prds?") | word("prd"), "prd")
        .when(folder("requirements?") | word("requirements?"), "requirement")
        .when(basename(low).isin(*POLICY_NAMES) | folder("policy|policies") | word("policy"), "policy")
        .otherwise("doc")
    )


def entity_kind(path: Column) -> Column:
    """Kind of a file: test, document kinds, policy, workflow, contract, resource, config or file; the first that fits."""
    lang = F.coalesce(language(path), F.lit(""))
    stem = F.lower(F.regexp_replace(basename(path), r"\.[^.]+$", ""))
    contract = stem.rlike("openapi|swagger|asyncapi")
    return (
        F.when(is_test(path), "test")
        .when(lang == "markdown", markdown_kind(path))
        .when(lang == "policy", "policy")
        .when((lang == "yaml") & path.startswith(".github/workflows/"), "workflow")
        .when(lang.isin("yaml", "json") & contract, "contract")
        .when(lang.isin("dockerfile", "terraform"), "resource")
        .when(basename(path).isin(*MANIFESTS), "config")
        .when(lang.isin("protobuf", "graphql"), "contract")
        .when(lang.isin(*CONFIG_LANGUAGES), "config")
        .otherwise("file")
    )


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def mentions(texts: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """``(id, name)``: texts (id, text) in which a name of at least ``least`` characters stands as a whole token.

    Tokens are matched by equality: an inverted index joined with the names,
    and not every text tried with every name.
    """
    held = texts.select("id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    wanted = names.select("name", F.lower("name").alias("token")).where(F.char_length("token") >= least)
    return held.join(wanted, "token").select("id", "name")


def escape_dot(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def shell_quote(text: Column) -> Column:
    safe = text.rlike(r"^[A-Za-z0-9_./:@%+=,-]+$")
    return F.when(safe, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def percent_encode(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def camel_to_snake(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))


def bytes_to_tokens(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)
