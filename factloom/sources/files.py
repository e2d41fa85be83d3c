"""Source trees as tables: walks, manifests, definitions and references."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalars import glob_regex, language_of

#: Folders that a walk leaves out.
SKIPPED = (".git", "node_modules", "vendor", "dist", "build", "target", "__pycache__", ".venv", ".idea", ".vscode")


def skipped(path: str):
    """Whether a path leads through a folder that a walk leaves out."""
    return F.col(path).rlike(f"/({'|'.join(re.escape(x) for x in SKIPPED)})/")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, content) of a tree's files, binary ones (a zero byte early on) and skipped folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    text = F.instr(F.substring("content", 1, 512).cast("string"), "\x00") == 0
    return files.where(~skipped("path") & text).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.lower(F.hex(F.xxhash64("content"))).alias("hash"))


def find(files: DataFrame, pattern: str, most: int = 1000) -> DataFrame:
    """Paths that a glob matches, the first by name."""
    return files.where(F.col("path").rlike(glob_regex(pattern))).select("path").orderBy("path").limit(most)


def read_lines(files: DataFrame, first: int, last: int) -> DataFrame:
    return files.select("path", F.array_join(F.slice(F.split(F.col("content").cast("string"), "\n", -1), first, last - first + 1), "\n").alias("text"))


def replaced(files: DataFrame, old: str, new: str, regex: bool = False) -> DataFrame:
    """(path, text, count) of files in which something is replaced."""
    text = F.col("content").cast("string")
    pattern = old if regex else re.escape(old)
    count = F.regexp_count(text, F.lit(pattern))
    return files.select("path", (F.regexp_replace(text, pattern, new) if regex else F.replace(text, F.lit(old), F.lit(new))).alias("text"), count.alias("count")).where("count > 0")


#: Patterns of definitions by language, for those without a parser here; group 1 is the name.
_DEFINES = {
    "go": r"(?m)^\s*(?:func(?:\s*\([^)]*\))?|type|var|const)\s+([A-Za-z_]\w*)",
    "typescript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let)\s+([A-Za-z_$][\w$]*)",
    "javascript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let)\s+([A-Za-z_$][\w$]*)",
    "java": r"(?m)^\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|type|const|mod)\s+([A-Za-z_]\w*)",
    "ruby": r"(?m)^\s*(?:def|class|module)\s+([A-Za-z_]\w*[?!]?)",
    "c": r"(?m)^\s*(?:typedef\s+)?(?:struct|enum|union)\s+([A-Za-z_]\w*)\s*\{|^[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{",
    "cpp": r"(?m)^\s*(?:class|struct|enum(?:\s+class)?|union|namespace)\s+([A-Za-z_]\w*)|^[A-Za-z_][\w\s*&:<>,]*?\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?\{",
    "csharp": r"(?m)^\s*(?:public|private|protected|internal|static|sealed|abstract|partial|\s)*(?:class|interface|struct|enum|record|namespace)\s+([A-Za-z_][\w.]*)",
    "kotlin": r"(?m)^\s*(?:public|private|internal|open|data|sealed|abstract|override|suspend|\s)*(?:class|interface|object|fun|val|var|typealias)\s+([A-Za-z_]\w*)",
    "php": r"(?m)^\s*(?:abstract\s+|final\s+|public\s+|private\s+|protected\s+|static\s+)*(?:function|class|interface|trait|enum)\s+&?([A-Za-z_]\w*)",
    "swift": r"(?m)^\s*(?:public|private|internal|open|final|static|\s)*(?:class|struct|enum|protocol|func|extension|let|var|typealias)\s+([A-Za-z_]\w*)",
    "scala": r"(?m)^\s*(?:abstract|final|sealed|implicit|case|override|private|protected|\s)*(?:class|object|trait|def|val|var|type)\s+([A-Za-z_]\w*)",
    "bash": r"(?m)^\s*(?:function\s+([A-Za-z_][\w-]*)|([A-Za-z_][\w-]*)\s*\(\)\s*\{)",
    "haskell": r"(?m)^(?:data|newtype|type|class)\s+([A-Z]\w*)|^([a-z_][\w']*)\s*::",
    "hcl": r'(?m)^\s*(?:resource|data)\s+"[^"]*"\s+"([^"]+)"|^\s*(?:variable|output|module|provider)\s+"([^"]+)"',
    "julia": r"(?m)^\s*(?:function|macro|(?:mutable\s+)?struct|abstract\s+type|module)\s+([A-Za-z_]\w*!?)",
    "lua": r"(?m)^\s*(?:local\s+)?function\s+([A-Za-z_][\w.:]*)",
    "ocaml": r"(?m)^\s*(?:let(?:\s+rec)?|type|module(?:\s+type)?|class|exception|val)\s+([A-Za-z_][\w']*)",
    "r": r"(?m)^\s*([A-Za-z_.][\w.]*)\s*(?:<-|=)\s*function\b",
    "zig": r"(?m)^\s*(?:pub\s+)?(?:export\s+)?(?:inline\s+)?(?:fn|const|var)\s+([A-Za-z_]\w*)",
}
#: Patterns of what a file imports, and of (type, what it extends or implements).
_IMPORTS = {
    "go": r'(?m)^\s*(?:import\s+)?(?:[A-Za-z_.]\w*\s+)?"([^"\s]+)"\s*$', "typescript": r"""(?m)^\s*(?:import|export)\b[^'"\n]*['"]([^'"]+)['"]""", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "ruby": r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""", "c": r'(?m)^\s*#\s*include\s+[<"]([^>"]+)[>"]', "csharp": r"(?m)^\s*using\s+([\w.]+)\s*;",
    "kotlin": r"(?m)^\s*import\s+([\w.]+)", "php": r"(?m)^\s*use\s+([\w\\]+)", "swift": r"(?m)^\s*import\s+(\w+)", "scala": r"(?m)^\s*import\s+([\w.]+)",
}
_IMPORTS |= {"javascript": _IMPORTS["typescript"], "cpp": _IMPORTS["c"]}
_HERITAGE = {
    "typescript": r"\b(?:class|interface)\s+(\w+)(?:<[^>{]*>)?\s+(?:extends|implements)\s+([\w\s,.<>]+?)\s*\{", "java": r"\b(?:class|interface|enum|record)\s+(\w+)(?:<[^>{]*>)?(?:\([^)]*\))?\s+(?:extends|implements)\s+([\w\s,.<>]+?)\s*\{",
    "ruby": r"(?m)^\s*class\s+(\w+)\s*<\s*([\w:]+)", "cpp": r"\b(?:class|struct)\s+(\w+)\s*:\s*([\w\s,:<>]+?)\s*\{", "csharp": r"\b(?:class|interface|struct|record)\s+(\w+)\s*:\s*([\w\s,.<>]+?)\s*(?:\{|where)",
    "kotlin": r"\b(?:class|interface|object)\s+(\w+)(?:\([^)]*\))?\s*:\s*([\w\s,.<>()]+?)\s*\{", "rust": r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)", "swift": r"\b(?:class|struct|enum|protocol|extension)\s+(\w+)\s*:\s*([\w\s,.]+?)\s*\{",
}
_HERITAGE |= {"javascript": _HERITAGE["typescript"]}
#: Languages that give a method's owner before its name, and those where it is the type whose braces hold it.
_RECEIVER = re.compile(r"(?m)^\s*func\s*\(\s*(?:\w+\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*(\w+)")
_OWNERS = re.compile(r"\b(?:class|interface|struct|enum|trait|object|record|namespace|mod|impl(?:<[^>]*>)?(?:\s+[\w:]+(?:<[^>]*>)?\s+for)?)\s+([A-Za-z_]\w*)[^{};]*\{")
_METHODS = re.compile(r"(?m)^[ \t]*(?:[\w<>\[\],.?*&:]+[ \t]+)*?([A-Za-z_]\w*)[ \t]*(?:<[^>(]*>)?\([^;{}]*\)[^;{}\n]*\{")
_BRACED = ("typescript", "javascript", "java", "rust", "cpp", "csharp", "kotlin", "php", "swift", "scala")
_NOT_METHODS = ("if", "for", "while", "switch", "catch", "return", "match", "when", "foreach", "function", "else")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def _python_tags(text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    stack = [(tree, "")]
    while stack:
        node, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            name = owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{owner}.{child.name}" if owner else child.name
                yield child.name, name, "def", child.lineno
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load):
                yield child.id, child.id, "ref", child.lineno
            elif isinstance(child, ast.Attribute):
                yield child.attr, child.attr, "ref", child.lineno
            stack.append((child, name))


def _braced_owners(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the braces of each type, outer ones first."""
    out, opened = [], {m.end() - 1: m[1] for m in _OWNERS.finditer(text)}
    stack = []
    for m in re.finditer("[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            if start in opened:
                out.append((start, m.start(), opened[start]))
    return sorted(out)


def qualified_names(language: str, text: str) -> dict[int, str]:
    """Qualified names (Type.method) of definitions, by where their name starts."""
    if language == "go":
        return {m.start(2): f"{m[1]}.{m[2]}" for m in _RECEIVER.finditer(text)}
    if language not in _BRACED:
        return {}
    owners, out = _braced_owners(text), {}
    names = [(m.start(1), m[1]) for m in _METHODS.finditer(text) if m[1] not in _NOT_METHODS]
    names += [(m.start(k), m[k]) for m in re.finditer(_DEFINES[language], text) for k in range(1, (m.lastindex or 0) + 1) if m[k]]
    for at, name in names:
        around = [o for a, b, o in owners if a < at < b]
        if around:
            out[at] = ".".join([*around, name])
    return out


def file_tags(language: str, text: str) -> list[tuple[str, str, str, int]]:
    """(name, qualified name, def or ref, line)."""
    if language == "python":
        return sorted(_python_tags(text), key=lambda x: (x[3], x[2], x[1]))
    pattern = _DEFINES.get(language)
    if not pattern:
        return []
    qualified = qualified_names(language, text)
    starts = {m.start(k) for m in re.finditer(pattern, text) for k in range(1, (m.lastindex or 0) + 1) if m[k]} | qualified.keys()
    out, line, at = [], 1, 0
    for m in _NAME.finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        out.append((m[0], qualified.get(m.start(), m[0]), "def" if m.start() in starts else "ref", line))
    return out


def file_structure(language: str, text: str) -> list[tuple[str, str | None, str]]:
    """(relation, of, to): what a file imports, and what its types inherit from, by relation `imports` or `inherits`; of: the type."""
    if language == "python":
        try:
            nodes = list(ast.walk(ast.parse(text)))
        except (SyntaxError, ValueError):
            return []
        out = [("imports", None, a.name) for n in nodes if isinstance(n, ast.Import) for a in n.names]
        out += [("imports", None, "." * n.level + (n.module or "")) for n in nodes if isinstance(n, ast.ImportFrom)]
        return out + [("inherits", n.name, ast.unparse(b)) for n in nodes if isinstance(n, ast.ClassDef) for b in n.bases]
    out = [("imports", None, m[1]) for m in re.finditer(_IMPORTS[language], text)] if language in _IMPORTS else []
    for m in re.finditer(_HERITAGE[language], text) if language in _HERITAGE else ():
        own, others = (m[2], m[1]) if language == "rust" else (m[1], m[2])
        for other in re.split(r",|\bextends\b|\bimplements\b", re.sub(r"<[^<>]*>|\([^()]*\)", "", others)):
            name = re.sub(r"^(?:public|private|protected|virtual)\s+", "", other.strip())
            if name:
                out.append(("inherits", own, name))
    return out


def structure(files: DataFrame) -> DataFrame:
    """(file, relation, of, to) of all files, in batches."""

    def extract(frames):
        for frame in frames:
            rows = [(p, *x) for p, lang, text in zip(frame["path"], frame["language"], frame["text"]) for x in file_structure(lang, text)]
            yield pd.DataFrame(rows, columns=["file", "relation", "of", "to"])

    own = files.select("path", language_of("path").alias("language"), F.col("content").cast("string").alias("text"))
    return own.mapInPandas(extract, "file string, relation string, of string, to string")


def tags(files: DataFrame) -> DataFrame:
    """(file, name, qualified, kind, line) of all files, in batches."""

    def extract(frames):
        for frame in frames:
            rows = [(p, *x) for p, lang, text in zip(frame["path"], frame["language"], frame["text"]) for x in file_tags(lang, text)]
            yield pd.DataFrame(rows, columns=["file", "name", "qualified", "kind", "line"])

    own = files.select("path", language_of("path").alias("language"), F.col("content").cast("string").alias("text"))
    return own.mapInPandas(extract, "file string, name string, qualified string, kind string, line int")


def traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; broken lines are kept in `_broken`."""
    return spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
