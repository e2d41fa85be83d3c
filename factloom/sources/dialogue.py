"""Dialogues as nested stream-JSON: what each line tells, and calls paired with their results as both come in.

A line is a message of some type; its content is a list of blocks of several kinds, so lines are parsed to variants and blocks taken out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a summary's bytes.
SUMMARY = 256
#: Counters of a result's usage block, and what they are called here.
USAGE = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_input_tokens": "cache_read_tokens", "cache_creation_input_tokens": "cache_creation_tokens"}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _summary(text: Column) -> Column:
    """The first bytes of a long text, and that there are more."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, SUMMARY).cast("string"))
    return F.when(F.octet_length(text) > SUMMARY, F.concat(head, F.lit("..."))).otherwise(text)


def dialogue_events(lines: DataFrame) -> DataFrame:
    """(file, at, nth, kind, time, session_id, model, servers, summary, call_id, tool, input, is_error, usage) of lines (file, at, line), in a stream or not.

    Kinds: session_init, api_retry, assistant (with the first text that is not empty, cut to a summary), tool_use (a row for each call of an assistant's
    message), tool_result, result (usage: null where none is reported, not zeros) and unknown: a line that is no JSON or of another type. Events of
    the stream itself and other lines of the system are left out. nth counts a line's rows; time is the line's timestamp, if it has one.
    """
    v = F.col("v")
    read = lines.where("trim(line) <> ''").select("file", "at", F.try_parse_json("line").alias("v"))
    kind, sub = _get(v, "$.type"), _get(v, "$.subtype")
    blocks = F.coalesce(_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    of = lambda name: F.filter(blocks, lambda b: _get(b, "$.type") == name)
    none = lambda kind: F.lit(None).cast(kind)
    usage_type = "struct<" + ",".join(f"{x}:bigint" for x in USAGE.values()) + ">"

    def event(name: str, **own: Column) -> Column:
        fields = {"session_id": none("string"), "model": none("string"), "servers": none("array<string>"), "summary": none("string"), "call_id": none("string"), "tool": none("string"), "input": none("string"), "is_error": none("boolean"), "usage": none(usage_type)}
        return F.struct(F.lit(name).alias("kind"), *[own.get(k, default).cast(kind_).alias(k) for (k, default), kind_ in zip(fields.items(), ("string", "string", "array<string>", "string", "string", "string", "string", "boolean", usage_type))])

    servers = F.transform(F.coalesce(_get(v, "$.mcp_servers", "array<variant>"), F.array().cast("array<variant>")), lambda s: _get(s, "$.name"))
    texts = F.filter(F.transform(of("text"), lambda b: _get(b, "$.text")), lambda t: t != "")
    said = event("assistant", summary=_summary(F.get(texts, 0)))
    calls = F.transform(of("tool_use"), lambda b: event("tool_use", call_id=_get(b, "$.id"), tool=_get(b, "$.name"), input=F.to_json(_get(b, "$.input", "variant"))))
    answers = F.transform(of("tool_result"), lambda b: event("tool_result", call_id=_get(b, "$.tool_use_id"), is_error=F.coalesce(_get(b, "$.is_error", "boolean"), F.lit(False))))
    used = F.when(_get(v, "$.usage", "variant").isNotNull(), F.struct(*[F.coalesce(_get(v, f"$.usage.{k}", "bigint"), F.lit(0).cast("long")).alias(x) for k, x in USAGE.items()]))
    nothing = F.slice(F.array(event("unknown")), 1, 0)
    rows = (
        F.when(kind == "assistant", F.concat(F.array(said), calls))
        .when(kind == "user", answers)
        .when((kind == "system") & (sub == "init"), F.array(event("session_init", session_id=_get(v, "$.session_id"), model=_get(v, "$.model"), servers=servers)))
        .when((kind == "system") & (sub == "api_retry"), F.array(event("api_retry")))
        .when(kind == "result", F.array(event("result", session_id=_get(v, "$.session_id"), usage=used)))
        .when(kind.isin("system", "stream_event"), nothing)
        .otherwise(F.array(event("unknown")))
    )
    return read.select("file", "at", _get(v, "$.timestamp").try_cast("timestamp").alias("time"), F.posexplode(rows).alias("nth", "x")).select("file", "at", "nth", "x.kind", "time", *[f"x.{c}" for c in ("session_id", "model", "servers", "summary", "call_id", "tool", "input", "is_error", "usage")])


def paired_calls(events: DataFrame, within: str = "1 hour", lateness: str = "10 minutes", how: str = "inner") -> DataFrame:
    """(file, call_id, tool, input, called, answered, is_error): calls with the results of their ids, within that time and in one file.

    Of a stream, both sides wait as state behind a watermark, so that it is bounded; `leftOuter` tells of calls without a result once the
    watermark is past their time. Rows without a time take no part.
    """
    timed = events.where("time is not null")
    calls = timed.where("kind = 'tool_use'").select(F.col("file").alias("file"), "call_id", "tool", "input", F.col("time").alias("called")).withWatermark("called", lateness)
    results = timed.where("kind = 'tool_result'").select(F.col("file").alias("_file"), F.col("call_id").alias("_id"), "is_error", F.col("time").alias("answered")).withWatermark("answered", lateness)
    near = F.expr(f"file = _file and call_id = _id and answered >= called and answered <= called + interval {within}")
    return calls.join(results, near, how).select("file", "call_id", "tool", "input", "called", "answered", "is_error")
