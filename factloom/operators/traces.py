"""Traces of tool calls: rules, metrics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches_in_order(calls: Column, pattern: list[str]) -> Column:
    """Whether the pattern is a subsequence of an array of tool names: a fold over the index of the next one that is wanted."""
    wanted = F.array(*[F.lit(x) for x in pattern])
    step = lambda s, x: F.when((s < len(pattern)) & (x == F.element_at(wanted, F.least(s + 1, F.lit(len(pattern))))), s + 1).otherwise(s)
    return F.aggregate(calls, F.lit(0), step) == len(pattern)


def runs(events: DataFrame) -> DataFrame:
    """(run, calls): the tools of each run in order of (t, ord), for runs that one row can hold."""
    listed = events.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("t", "ord", "tool"))).alias("x"))
    return listed.select("run", F.transform("x", lambda e: e["tool"]).alias("calls"))


def without_prior(events: DataFrame, tool: str, prior: str) -> DataFrame:
    """(run, violations): calls of a tool that no call of another came before."""
    first = events.where(F.col("tool") == prior).groupBy("run").agg(F.min(F.struct("t", "ord")).alias("_first"))
    marked = events.where(F.col("tool") == tool).join(first, "run", "left")
    return marked.groupBy("run").agg(F.count_if(F.col("_first").isNull() | (F.struct("t", "ord") < F.col("_first"))).alias("violations"))


def tool_totals(results: DataFrame) -> DataFrame:
    """(mode, tool, n): the sums of the results' maps `tools` (tool to calls)."""
    return results.select("mode", F.explode("tools").alias("tool", "calls")).groupBy("mode", "tool").agg(F.sum("calls").alias("n"))


def tool_maps(results: DataFrame) -> DataFrame:
    """(mode, tools): the same as one map for each mode."""
    pairs = F.sort_array(F.collect_list(F.struct("tool", "n")))
    return tool_totals(results).groupBy("mode").agg(F.map_from_entries(pairs).alias("tools"))


def safety_totals(results: DataFrame) -> DataFrame:
    """(mode, warned, blocked, receipts_issued): sums by mode, nulls as none."""
    return results.groupBy("mode").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("warned", "blocked", "receipts_issued")])


def histograms(calls: DataFrame, bounds: list[float]) -> DataFrame:
    """(tool, le, n): cumulative counts of durations up to each bound and, with a null bound, of all; null durations are in that alone."""
    rows = calls.groupBy("tool").agg(*[F.count_if(F.col("duration") <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("*").alias("all"))
    each = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    return rows.select("tool", F.explode(F.array(*each, F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))).alias("x")).select("tool", "x.le", "x.n")


def tool_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.countDistinct("run").alias("runs"))


def report(results: DataFrame) -> DataFrame:
    """Per mode and overall (null mode): tasks, success rate, mean tokens and duration."""
    return results.rollup("mode").agg(F.count("*").alias("tasks"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("tokens").alias("mean_tokens"), F.avg("duration").alias("mean_duration"), F.sum("tokens").alias("total_tokens"))


def precision_recall(calls: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """Share of calls that are relevant, share of expected items that were called; null where undefined."""
    hit = calls.join(expected.select(by, "item", F.lit(True).alias("wanted")).distinct(), [by, "item"], "left")
    got = hit.groupBy(by).agg(F.count("*").alias("calls"), F.count_if("wanted").alias("relevant"), F.countDistinct(F.when(F.col("wanted"), F.col("item"))).alias("found"))
    want = expected.groupBy(by).agg(F.countDistinct("item").alias("expected"))
    both = got.join(want, by, "full_outer")
    return both.select(by, F.expr("relevant / nullif(calls, 0)").alias("precision"), F.expr("coalesce(found, 0) / nullif(expected, 0)").alias("recall"))


def regression_rate(pre: DataFrame, post: DataFrame, key: list[str]) -> DataFrame:
    """Of the tests that passed before, those that no longer do: skipped ones are not among these, absent ones are."""
    passed = pre.where("passed and not skipped").select(*key)
    after = passed.join(post.select(*key, F.col("passed").alias("_p"), F.col("skipped").alias("_s")), key, "left")
    lost = ~F.coalesce("_p", F.lit(False)) & ~F.coalesce("_s", F.lit(False))
    return after.agg(F.count("*").alias("tests"), F.count_if(lost).alias("regressed")).select("tests", "regressed", F.expr("regressed / nullif(tests, 0)").alias("rate"))


def rubric(scores: DataFrame, dimensions: list[str], least: float = 0.7) -> DataFrame:
    """(dimension, mean, weak), the weakest first, of one column for each dimension."""
    long = scores.unpivot([], dimensions, "dimension", "value")
    return long.groupBy("dimension").agg(F.avg("value").alias("mean")).select("dimension", "mean", (F.col("mean") < least).alias("weak")).orderBy("mean", "dimension")


def evidence_confidence(evidence: DataFrame, top: int = 10, partial_cap: float = 0.6) -> DataFrame:
    """(edge, confidence, citations): contributions of the strongest citations, at most 1, less where some are partial."""
    place = F.row_number().over(Window.partitionBy("edge").orderBy(F.desc("contribution"), "citation"))
    best = evidence.withColumn("_n", place).where(F.col("_n") <= top)
    summed = best.groupBy("edge").agg(F.sum("contribution").alias("s"), F.max(F.col("partial").cast("int")).alias("p"), F.count("*").alias("citations"))
    return summed.select("edge", F.when(F.col("p") == 1, F.least(F.col("s"), F.lit(partial_cap))).otherwise(F.least(F.col("s"), F.lit(1.0))).alias("confidence"), "citations")


def trace_metrics(events: DataFrame, readers: list[str], diagnostics: list[str], semantic: list[str]) -> DataFrame:
    """Per run: calls, reads and their bytes, diagnostics, retries, seconds between the first and the last timed event.

    Events are (run, t, tool, kind, bytes); the seconds are null where no event of a run has a time.
    """
    among = lambda tools: F.coalesce(F.col("tool").isin(tools), F.lit(False))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = (micros(F.max("t")) - micros(F.min("t"))) / 1e6
    return events.groupBy("run").agg(F.count("tool").alias("tool_calls"), F.count_if(among(semantic)).alias("semantic_calls"), F.count_if(among(readers)).alias("files_read"), F.coalesce(F.sum(F.when(among(readers), F.col("bytes"))), F.lit(0)).alias("bytes_read"), F.count_if(among(diagnostics)).alias("diagnostics_used"), F.count_if(F.col("kind") == "api_retry").alias("retries"), seconds.alias("wall_seconds"))


def token_meter(runs_: DataFrame, counters: list[str]) -> DataFrame:
    """The counters of runs whose provider reported usage, with nulls as zero; null, not zero, for the others."""
    return runs_.select("run", *[F.when(F.col("usage_present"), F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters])


def edit_locality(tracked: DataFrame, changed: DataFrame, by: str) -> DataFrame:
    """(by, modified, locality): one less the share of tracked paths that changed; null where nothing is tracked."""
    hit = tracked.select(by, "path").distinct().join(changed.select(by, "path", F.lit(1).alias("_hit")).distinct(), [by, "path"], "left")
    counts = hit.groupBy(by).agg(F.count("_hit").alias("modified"), (1 - F.count("_hit") / F.count("*")).alias("locality"))
    groups = tracked.select(by).union(changed.select(by)).distinct()
    return groups.join(counts, by, "left").select(by, F.coalesce("modified", F.lit(0).cast("long")).alias("modified"), "locality")


def patch_distance(numstat: DataFrame, by: str) -> DataFrame:
    """(by, distance) of lines `added TAB deleted TAB path`: what was added and deleted; null where a line is malformed.

    A binary file's dashes count nothing, and a line of fewer fields is passed over.
    """
    parts = F.split("line", "\t", 3)
    rows = numstat.select(by, parts.alias("p")).where((F.size("p") == 3) & ~((F.col("p")[0] == "-") & (F.col("p")[1] == "-")))
    added, deleted = F.col("p")[0].try_cast("long"), F.col("p")[1].try_cast("long")
    sums = rows.groupBy(by).agg(F.when(F.count_if(added.isNull() | deleted.isNull()) == 0, F.sum(added + deleted)).alias("distance"), F.lit(True).alias("_had"))
    return numstat.select(by).distinct().join(sums, by, "left").select(by, F.when(F.col("_had").isNull(), F.lit(0).cast("long")).otherwise(F.col("distance")).alias("distance"))


def verdicts(scores: DataFrame) -> DataFrame:
    """One row: transcripts, how many passed, failed softly and failed, and whether any was judged by itself."""
    return scores.agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("pass", "soft_fail", "fail")], F.coalesce(F.bool_or("self_judged"), F.lit(False)).alias("self_judged"))


def merged_timeline(first: DataFrame, second: DataFrame) -> DataFrame:
    """Events (run, t, ord, tool) of two sources with their place in each run: by time, the first source before the second at ties."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("t", "source", "ord")))
