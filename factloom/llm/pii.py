"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, schemes and identifier cues in one pass; local
parsers expand each anchor to its boundaries and validate them. Digits anchor the ip and card parsers.
The parsers of email, ip, card and phone accept what the base patterns match from left to right. Beyond
the base: `iban` (checksum of a country-led account), `account` (digits after an account cue), `login`
(user and password within a URL).

Null text: empty. Null doc_id: the row stays. Repeated rows: one result each. Empty table: no rows. Other
columns, whatever their names, are not read. Spans that start together are listed in the order of KINDS, then by
their ends. Very long texts are read whole: each parser is linear in what it reads, as its runs never give back what
they took and no two anchors' runs share a character, so that logins and runs of white space have no longest length.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "login")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\s:]*+([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"""["']?+\s*+(?:number|no\.?+|nr\.?+|id|#)?+["']?+\s*+[:=#]?+\s*+["']?+([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])""", re.IGNORECASE)
_LOGIN = re.compile(r"([^\s/@:]++:[^\s/@]++)@")
#: Fixed cues, in lower case.
_CUES = {"@": "at", "+": "plus", "://": "scheme", "iban": "iban", "account": "account", "acct": "account", "ssn": "account", "passport": "account", "konto": "account", "cuenta": "account", "compte": "account"}


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue, kind in _CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def personal_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): code points, end exclusive."""
    out, lower = [], text.lower()
    if len(lower) != len(text):  # some letters grow when lowered: lower the ASCII ones alone
        lower = "".join(c.lower() if c.isascii() else c for c in text)
    email_end = phone_end = 0
    for last, (kind, size) in _anchors().iter(lower):
        at, end = last + 1 - size, last + 1
        if kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, end)):
                out.append((start, m.end(), "email"))
                email_end = m.end()
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((at, m.end(), "phone"))
        elif kind == "scheme":
            if m := _LOGIN.match(text, end):
                out.append((m.start(1), m.end(1), "login"))
        elif kind == "iban":
            if (m := _IBAN.match(text, end)) and iban_valid(m[1].replace(" ", "")):
                out.append((m.start(1), m.end(1), "iban"))
        elif m := _ACCOUNT.match(text, end):
            out.append((m.start(1), m.end(1), "account"))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for each row of documents."""

    def scan(batches):
        for batch in batches:
            every = [sorted(set(personal_spans(x))) for x in batch.column("text").to_pylist()]
            base = [[s for s in spans if s[2] in BASE] for spans in every]
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in BASE]
            hashes = pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, hashes, pa.array(map(_joined, every), pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return texts(documents).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
