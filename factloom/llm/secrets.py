"""Secret scans by assignment-aware lexing.

Base patterns give assign, access and hex spans. The lexer reads source and configuration syntax: at each
sign of assignment it parses a name to the left and a literal, or another name, to the right (`a = "x"`,
`a: x`, `"a": "x"`, `a := 'x'`, `a => "x"`, `export A=x`, `<a>x</a>`). Constants carry over: a name that
is given another name takes its literals, whatever number of steps away. Literals are scored by how
sensitive the names are that they reach; those over the threshold are `lexed` spans.

Null text: empty. Null doc_id: the row stays. Repeated rows: one result each. Empty table: no rows. Other columns,
whatever their names, are not read by the scan and kept as they are by the redaction. Spans that start together are
listed in the order of KINDS, then by their ends.
Very long texts are read whole, in time that grows with their length: neither names nor literals have a longest
length, those that end together (`a=b=c`) are read once, from the right, and scores reach each name once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table, texts

THRESHOLD = 1.0
KINDS = ("assign", "access", "hex", "lexed")
REDACTED = "[secret]"

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Fixed weights of the parts of a sensitive name.
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "api": 0.4, "key": 0.5, "signing": 0.4, "client": 0.2,
    "session": 0.4, "salt": 0.5, "dsn": 0.5, "connection": 0.3,
}
_HARMLESS = re.compile(r"(?i)(?:true|false|none|null|nil|undefined|changeme|example|placeholder|x++|\*++|<.*>|\$\{.*\}|%.*%)$|your[_-]")
_SIGN = re.compile(r":=|=>|=|:|</")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+")
_QUOTED = re.compile(r"""[ \t]*+(?:"([^"\n]++)"|'([^'\n]++)')""")
_BLANK = re.compile(r"[ \t]*+")
_PLAIN = re.compile(r"[A-Za-z0-9+/_.=\-]++")
_TAG = re.compile(r"[A-Za-z_][\w.\-]*+")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    return sum(_SENSITIVE.get(x.lower(), 0.0) for x in set(_PARTS.findall(name)))


def plausibilities(text: str, spans: list[tuple[int, int]]) -> list[float]:
    """0 to 1 for each span, in order of their starts: how much a literal looks like a secret, by its length and the entropy of its characters."""
    out, counts, low, high = [], Counter(), 0, -1
    for start, end in reversed(spans):
        if end == high and start <= low:  # the rest of it is counted
            counts.update(text[start:low])
        else:
            counts = Counter(text[start:end])
        low, high, size = start, end, end - start
        if size < 8 or _HARMLESS.match(text, start, end) or counts[" "] > 1:
            out.append(0.0)
        else:
            out.append(min(1.0, -sum(n / size * math.log2(n / size) for n in counts.values() if n) / 3.0))
    return out[::-1]


def plausibility(literal: str) -> float:
    return plausibilities(literal, [(0, len(literal))])[0]


def _name_before(text: str, end: int) -> str | None:
    """The name that ends before a sign of assignment, of any length; a quote or bracket and blanks may stand between."""
    while end and text[end - 1] in " \t":
        end -= 1
    end -= end > 0 and text[end - 1] in "\"']"
    start = end
    while start and text[start - 1] in _NAME_CHARS:
        start -= 1
    while start < end and text[start] in "0123456789.-":
        start += 1
    return text[start:end] or None


def _whole(pattern: re.Pattern, text: str, start: int, end: int) -> bool:
    """Whether the pattern, of possessive runs, takes all of a span; it is read no further than the run goes."""
    found = pattern.match(text, start, end)
    return found is not None and found.end() == end


def assignments(text: str) -> list[tuple[str, int, int, bool]]:
    """(name, start, end, quoted) for each assignment of a literal in the text, in order."""
    out, closed, plain = [], 0, 0
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if sign[0] == "</":
            # Neither the literal nor its tag holds a "<": both lie behind the last closing tag.
            over = text.rfind(">", closed, at)
            under = text.rfind("<", closed, over) if over >= 0 else -1
            end = at - (at > 0 and text[at - 1] == "\n")
            if under >= 0 and over + 1 < end and text.find("<", over, end) < 0 and text.find("\n", over, end) < 0 and (tag := _TAG.fullmatch(text, under + 1, over)):
                out.append((tag[0], over + 1, end, True))
            closed = at
            continue
        if right := _QUOTED.match(text, sign.end()):
            start, end = right.span(right.lastindex)
        else:
            start = _BLANK.match(text, sign.end()).end()
            if start >= plain:  # else it ends where the one before does
                right = _PLAIN.match(text, start)
                if right is None:
                    continue
                plain = right.end()
            end = plain
        name = _name_before(text, at)
        if name is not None:
            out.append((name, start, end, right is not None and right.re is _QUOTED))
    return out


def name_literal_pairs(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, literal, start, end, quoted) for each assignment in the text, in order."""
    return [(name, text[start:end], start, end, quoted) for name, start, end, quoted in assignments(text)]


def lexed(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, by any number of copies from name to name."""
    pairs = assignments(text)
    if not pairs:
        return []
    sources: dict[str, set[str]] = defaultdict(set)
    for name, start, end, quoted in pairs:
        if not quoted and _whole(_IDENTIFIER, text, start, end):
            sources[name].add(text[start:end])
    names = {p[0] for p in pairs}
    # A name reaches whatever it is copied to: from the most sensitive name on, its sources take its score, each once.
    best: dict[str, float] = {}
    for score, name in sorted(((sensitivity(n), n) for n in names), reverse=True):
        open_names = [name]
        while open_names:
            own = open_names.pop()
            if own not in best:
                best[own] = score
                open_names += sources.get(own, ())
    held = []
    for name, start, end, quoted in pairs:
        if not quoted and (_whole(_NAME, text, start, end) and text[start:end] in names or _whole(_IDENTIFIER, text, start, end) and text[start:end].isalpha()):
            continue
        if best[name] > 0:
            held.append((start, end, best[name]))
    held.sort()
    out = [(start, end) for (start, end, score), p in zip(held, plausibilities(text, [x[:2] for x in held])) if score + p >= threshold + 0.7 and p > 0.5]
    return sorted(set(out))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    return base_spans(text) + [(a, b, "lexed") for a, b in lexed(text)]


def secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for each row of documents."""

    def scan(batches):
        for batch in batches:
            read = batch.column("text").to_pylist()
            base = [base_spans(x) for x in read]
            every = [s + [(a, b, "lexed") for a, b in lexed(x)] for s, x in zip(base, read)]
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS[:3]]
            hashes = pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, hashes, pa.array(map(_joined, every), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts(documents).mapInArrow(lean(scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    """The text with each stretch that spans cover replaced by a mark."""
    out, at, end = [], 0, -1
    for a, b, _ in sorted(secret_spans(text)):
        if a > end:
            if end >= 0:
                at = end
            out += [text[at:a], REDACTED]
        end = max(end, b)
    return text if end < 0 else "".join([*out, text[end:]])


def redact_secrets(documents: DataFrame) -> DataFrame:
    """documents with secrets replaced by a mark; n_chars is counted again where the table has it."""

    def clean(batches):
        for batch in batches:
            new = [None if x is None else redacted(x) for x in batch.column("text").to_pylist()]
            sizes = [None if x is None else len(x) for x in new]
            columns = [pa.array(new, pa.string()) if name == "text" else pa.array(sizes, batch.schema.field(name).type) if name == "n_chars" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return documents.mapInArrow(lean(clean), documents.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
