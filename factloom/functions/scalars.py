"""Scalar functions, all of them column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed mapping of file extensions to languages.
LANGUAGES = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".rs": "rust", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".cs": "csharp", ".kt": "kotlin", ".php": "php", ".swift": "swift", ".scala": "scala", ".mjs": "javascript", ".cjs": "javascript", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".sh": "bash", ".bash": "bash", ".hs": "haskell", ".tf": "hcl", ".hcl": "hcl", ".jl": "julia", ".kts": "kotlin", ".lua": "lua", ".ml": "ocaml", ".mli": "ocaml", ".r": "r", ".zig": "zig"}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def identifier_tokens(name) -> Column:
    """The name itself, then its camel, snake and kebab parts."""
    parts = F.split(F.regexp_replace(_col(name), "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "), "[ _-]+")
    parts = F.filter(parts, lambda x: x != "")
    return F.when(_col(name) == "", F.array().cast("array<string>")).otherwise(F.when(F.size(parts) > 1, F.concat(F.array(_col(name)), parts)).otherwise(F.array(_col(name))))


def path_tokens(path) -> Column:
    return F.filter(F.split(_col(path), r"[/\\.-]+"), lambda x: x != "")


def token_cost(text) -> Column:
    """Tokens by the rule of four bytes each."""
    return F.floor(F.octet_length(_col(text)) / 4).cast("long")


def candidate_cost(id_, terms) -> Column:
    return F.lit(8) + F.floor(F.length(_col(id_)) / 4) + F.aggregate(_col(terms), F.lit(0).cast("long"), lambda s, t: s + F.floor(F.length(t) / 4))


def impact_confidence(weight) -> Column:
    w = _col(weight)
    return F.when(w >= 1, 0.95).when(w >= 0.8, 0.8).when(w >= 0.6, 0.7).otherwise(0.45)


def score_status(row_exists, version, current, exact) -> Column:
    """missing, then approximate, then stale, then exact."""
    return F.when(~row_exists, "missing").when(~exact, "approximate").when(version < current, "stale").otherwise("exact")


def clamp(x, low=0.0, high=1.0) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def language_of(path) -> Column:
    extension = F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))
    found = F.lit("unknown")
    for key, value in LANGUAGES.items():
        found = F.when(extension == key, value).otherwise(found)
    return found


def glob_regex(pattern: str) -> str:
    """A glob (`*`, `?`, `**`, `[..]`) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := pattern.find("]", i + 1)) > 0:
            out, i = out + pattern[i : end + 1].replace("[!", "[^"), end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r".^$+{}()|[]\\" else c)
        i += 1
    return f"^{out}$"


def stable_id(*columns) -> Column:
    """A 63-bit id of key columns."""
    return F.xxhash64(F.concat_ws("\x00", *[_col(c).cast("string") for c in columns])).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def cluster_token(projection, version, cluster) -> Column:
    return F.concat_ws(":", _col(projection), _col(version).cast("string"), _col(cluster).cast("string"))


def cluster_token_parts(token) -> Column:
    """(projection, graph_version, cluster_id) or null where the token is not well formed."""
    parts = F.split(_col(token), ":")
    whole = F.struct(parts[0].alias("projection"), parts[1].try_cast("long").alias("graph_version"), parts[2].try_cast("long").alias("cluster_id"))
    return F.when((F.size(parts) == 3) & parts[1].try_cast("long").isNotNull() & parts[2].try_cast("long").isNotNull(), whole)


def first_non_empty(*layers) -> Column:
    return F.coalesce(*[F.when(_col(x) != "", _col(x)) for x in layers])
