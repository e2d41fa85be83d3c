"""Where a block of lines stands in a text, by ever looser rules, and what takes its place: array expressions, row by row, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.codes import reflowed

#: The rules, from the strictest on, and what a match by them is worth.
RULES = (("exact", 1.0), ("whitespace_normalized", 0.95), ("indent_flexible", 0.85))
#: Fixed value: a line that stands for any lines.
_GAP = r"(?m)^[ \t]*\.\.\.$"
_SPACE = r"[\s\x85\p{Z}]"


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), which is made once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")


def _by_rule(lines: Column) -> list[Column]:
    """Lines as each rule compares them: as they are, without outer white space, without leading blanks and tabs. White space inside a line always counts."""
    return [lines, F.transform(lines, _bare), F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t]+", ""))]


def _places(whole: Column, part: Column, start: Column) -> Column:
    """Indices, from 0 and not before start, at which the lines of part follow one another in whole."""
    last = F.size(whole) - F.size(part)
    return F.when(last >= start, F.filter(F.sequence(start, F.greatest(last, start)), lambda i: F.slice(whole, i + 1, F.size(part)) == part)).otherwise(F.array().cast("array<int>"))


def _segments(text: Column) -> Column:
    return F.split(text, _GAP, -1)


def _trimmed(segment: Column) -> Column:
    """A segment without one line break at either end."""
    return F.regexp_replace(F.regexp_replace(segment, r"\n\z", ""), r"\A\n", "")


def line_matches(cases: DataFrame) -> DataFrame:
    """(id, strategy, score, first, after, start, end, text, error) of cases (id, source, search, replacement).

    The first rule by which the search's lines stand anywhere decides; several places are `ambiguous`, none is `no match`. Lines `...` of
    the search stand for any lines: the segments between them match one after another, each behind the one before, and the weakest gives strategy and score.
    first and after count lines from 0, start and end bytes. text is what stands there afterwards: the replacement, by segments, its margin changed to that
    of the place; null without a replacement. Other errors: `empty` (nothing is searched for), `empty segment`, `segments` (the replacement has not as many).
    Null sources and searches are empty.
    """
    own = cases.select("id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("search", F.lit("")).alias("search"), F.col("replacement"))
    blank = lambda x: _bare(x) == ""
    cut = own.select("*", _segments(F.col("search")).alias("_s"), _segments(F.col("replacement")).alias("_r"))
    parted = F.size("_s") > 1
    wrong = (
        F.when(blank(F.col("search")), "empty")
        .when(parted & F.exists("_s", blank), "empty segment")
        .when(parted & F.col("replacement").isNotNull() & (F.size("_r") > 1) & F.exists("_r", blank), "empty segment")
        .when(parted & F.col("replacement").isNotNull() & (F.size("_r") != F.size("_s")), "segments")
    )
    whole = F.array(F.struct(F.col("search").alias("s"), F.col("replacement").alias("r")))
    each = F.transform("_s", lambda s, i: F.struct(_trimmed(s).alias("s"), _trimmed(F.get(F.col("_r"), i)).alias("r")))
    ready = cut.select("id", "source", wrong.alias("wrong"), F.when(parted, each).otherwise(whole).alias("pieces"), *[x.alias(f"l{k}") for k, x in enumerate(_by_rule(_lines(F.col("source"))))])

    def step(state: Column, piece: Column) -> Column:
        wanted = _by_rule(_lines(piece["s"]))
        hits = [_places(F.col(f"l{k}"), wanted[k], state["after"]) for k in range(3)]
        named = lambda k, h: F.struct(F.lit(k).alias("rule"), h.alias("hits"))
        found = _let(hits[0], lambda a: F.when(F.size(a) > 0, named(0, a)).otherwise(_let(hits[1], lambda b: F.when(F.size(b) > 0, named(1, b)).otherwise(named(2, hits[2])))))

        def taken(x: Column) -> Column:
            at = F.get(x["hits"], 0)
            end = at + F.size(wanted[0])
            text = F.array_join(reflowed(_lines(piece["r"]), wanted[0], F.slice(F.col("l0"), at + 1, F.size(wanted[0]))), "\n")
            one = F.size(x["hits"]) == 1
            return F.struct(
                F.when(one, F.coalesce(state["first"], at)).otherwise(state["first"]).alias("first"),
                F.when(one, end).otherwise(state["after"]).alias("after"),
                F.greatest(state["rule"], x["rule"]).alias("rule"),
                F.when(one & piece["r"].isNotNull(), F.concat(state["texts"], F.array(text))).otherwise(state["texts"]).alias("texts"),
                F.when(F.size(x["hits"]) == 0, "no match").when(~one, "ambiguous").alias("error"),
            )

        return F.when(state["error"].isNotNull(), state).otherwise(_let(found, taken))

    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(none("int").alias("first"), F.lit(0).alias("after"), F.lit(0).alias("rule"), F.array().cast("array<string>").alias("texts"), none("string").alias("error"))
    end = F.when(F.col("wrong").isNull(), F.aggregate("pieces", start, step))
    done = ready.select("id", "l0", F.coalesce("wrong", end["error"]).alias("error"), end.alias("m"), F.octet_length("source").alias("bytes"), (F.size("pieces") > 0).alias("some"))
    ok, m = F.col("error").isNull(), F.col("m")
    before = lambda n: F.aggregate(F.slice("l0", 1, n), F.lit(0), lambda s, x: s + F.octet_length(x) + 1)
    pick = lambda k: F.get(F.array(*[F.lit(r[k]) for r in RULES]), m["rule"])
    return done.select(
        "id",
        F.when(ok, pick(0)).alias("strategy"),
        F.when(ok, pick(1)).alias("score"),
        F.when(ok, m["first"]).alias("first"),
        F.when(ok, m["after"]).alias("after"),
        F.when(ok, before(m["first"])).alias("start"),
        F.when(ok, F.when(m["after"] >= F.size("l0"), F.col("bytes")).otherwise(before(m["after"]) - 1)).alias("end"),
        F.when(ok & (F.size(m["texts"]) > 0), F.array_join(m["texts"], "\n...\n")).alias("text"),
        "error",
    )
