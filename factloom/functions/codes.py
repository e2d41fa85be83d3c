"""Scalar functions on identities, signatures, indents and messages; column expressions unless they say otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of an answer that its payload may not override.
RESERVED = ("source", "fallback_reason", "graph_version", "freshness")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fnv1a(text) -> Column:
    """FNV-1a of 64 bits over a string's bytes as 16 hex digits, in two halves, as products of 64 bits overflow."""
    hexed = F.hex(F.encode(F.coalesce(_col(text), F.lit("")), "utf-8"))
    size = (F.length(hexed) / 2).cast("int")
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(hexed, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    low = F.lit(0xFFFFFFFF)

    def step(s, b):
        x = s["lo"].bitwiseXOR(b)
        product = x * 435  # the prime is 2^40 + 435
        return F.struct((s["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(x, 8)).bitwiseAND(low).alias("hi"), product.bitwiseAND(low).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(octets, start, step, lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0"))))


def note_hash(content) -> Column:
    """The first 128 bits of a note's sha256."""
    return F.substring(F.sha2(F.coalesce(_col(content), F.lit("")), 256), 1, 32)


def task_hash(*parts) -> Column:
    """16 hex digits that name a task by its parts."""
    return F.substring(F.sha2(F.concat_ws("\x00", *[F.coalesce(_col(p), F.lit("")) for p in parts]), 256), 1, 16)


def under_topic(name, topic: str) -> Column:
    """Whether a note stands below a topic; the topic's own wildcards are plain characters."""
    plain = topic.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return _col(name).like(f"{plain}/%")


def method_of_source(source) -> Column:
    """The method of an edge's source `lsp.<language>.<method>`, or what follows the prefix; empty for other sources."""
    rest = F.regexp_extract(_col(source), r"^lsp\.(.*)$", 1)
    return F.when(rest.contains("."), F.regexp_replace(rest, r"^[^.]*\.", "")).otherwise(rest)


def path_of_uri(uri) -> Column:
    return F.regexp_replace(_col(uri), "^file://", "")


def package_of_path(path) -> Column:
    """The folder of a file, `.` at the top."""
    folder = F.regexp_extract(_col(path), "^(.*)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.when(_col(path).startswith("/"), "/").otherwise("."))


def envelope(source, payload: dict[str, Column], reason=None, version=None, freshness=None) -> Column:
    """An answer as JSON: its source and, where they are given and not empty, reason, version and freshness, then the payload without reserved keys."""
    held = [_col(source).alias("source")]
    if reason is not None:
        held.append(F.when(_col(reason) != "", _col(reason)).alias("fallback_reason"))
    if version is not None:
        held.append(F.when(_col(version) != 0, _col(version)).alias("graph_version"))
    if freshness is not None:
        held.append(F.when(_col(freshness) != "", _col(freshness)).alias("freshness"))
    return F.to_json(F.struct(*held, *[c.alias(k) for k, c in payload.items() if k not in RESERVED]))


def epoch_millis(time) -> Column:
    return F.unix_millis(_col(time).cast("timestamp"))


def holds_receipts(args) -> Column:
    """Whether a call's arguments list a receipt: something but white space between `receipts:[` and the next bracket."""
    return F.coalesce(_col(args).contains("receipts:[") & (F.trim(F.regexp_extract(_col(args), r"receipts:\[([^\]]*)\]", 1)) != ""), F.lit(False))


def argument_match(args, words: list[str], patterns: list[str]) -> Column:
    """Whether a call's arguments hold all words and match all patterns."""
    found = F.lit(True)
    for word in words:
        found = found & _col(args).contains(word)
    for pattern in patterns:
        found = found & _col(args).rlike(pattern)
    return F.coalesce(found, F.lit(False))


_BLANK = r"^[ \t]*$"


def _margin(line: Column) -> Column:
    return F.regexp_extract(line, r"^([ \t]*)", 1)


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once: an expression that stands in a lambda is worked out for each element."""
    return F.transform(F.array(value), f)[0]


def common_margin(lines) -> Column:
    """The white space that all lines of an array begin with, blank ones aside."""
    margins = F.transform(F.filter(_col(lines), lambda x: ~x.rlike(_BLANK)), _margin)

    # the longest common prefix of all is that of the smallest and the greatest
    def common(ends):
        low, high = ends["low"], ends["high"]
        places = F.sequence(F.lit(0), F.least(F.length(low), F.length(high)))
        same = F.array_max(F.filter(places, lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n)))
        return F.substring(low, F.lit(1), same)

    ends = _bound(margins, lambda m: F.struct(F.array_min(m).alias("low"), F.array_max(m).alias("high")))
    return F.coalesce(_bound(ends, common), F.lit(""))


def dedented(lines, margin) -> Column:
    """Lines without a margin, where they have it; blank lines empty."""

    def cut(m):
        return F.transform(_col(lines), lambda x: F.when(x.rlike(_BLANK), "").when(x.startswith(m), F.substring(x, F.length(m) + 1, F.length(x))).otherwise(x))

    return _bound(_col(margin), cut)


def indented(lines, margin) -> Column:
    return _bound(_col(margin), lambda m: F.transform(_col(lines), lambda x: F.when(x.rlike(_BLANK), "").otherwise(F.concat(m, x))))


def reflowed(replacement, searched, matched) -> Column:
    """A replacement's lines with the margin of what was searched for changed to that of the first line that it was found at."""
    first = F.element_at(F.concat(F.filter(_col(matched), lambda x: ~x.rlike(_BLANK)), F.array(F.lit(""))), 1)
    return indented(dedented(replacement, common_margin(searched)), _margin(first))


def signature_hashes(symbols: DataFrame) -> DataFrame:
    """(id, signature, hash) of symbols (id, signature): the canonical form, which renamed type parameters do not change, in batches."""

    def each(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "signature": [canonical_signature(x or "") for x in frame["signature"]]})

    own = symbols.select("id", "signature").mapInPandas(each, f"id {symbols.schema['id'].dataType.simpleString()}, signature string")
    return own.withColumn("hash", F.substring(F.sha2("signature", 256), 1, 16))


def canonical_signature(text: str) -> str:
    """A signature without its body, with single blanks and type parameters named by their place. Plain Python, for batches."""
    own = " ".join(text.partition("{")[0].split())
    open_ = own.find("[")
    if open_ < 0:
        return own
    depth = 0
    for close in range(open_, len(own)):
        depth += {"[": 1, "]": -1}.get(own[close], 0)
        if not depth:
            break
    else:
        return own
    if close + 1 >= len(own) or own[close + 1] != "(":  # an array or an index, not a list of type parameters
        return own
    names = [m[0] for part in own[open_ + 1 : close].split(",") if (m := re.match(r"\s*[A-Za-z_]\w*", part))]
    place = {name.strip(): f"T{k}" for k, name in enumerate(names)}
    return re.sub(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*", lambda m: place.get(m[0], m[0]), own)
