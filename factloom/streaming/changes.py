"""Change events: coalescing in batches and in streams.

The merge of two changes is not commutative, so a key's events are folded in order. In batches an hour of a key is
folded into what it does to each kind that may stand before it, and these few maps are folded in turn, so that
no row holds a key's whole history; in streams a stateful operator emits a key when it has been quiet for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUIET_MS, MOST_MS, BULK = 250, 1500, 200


def merged(before: str | None, now: str) -> str | None:
    """The kind of two changes of one path; None: they undo each other."""
    if before is None:
        return now
    if before == "created":
        return None if now == "deleted" else "created"
    if before == "deleted" and now == "created":
        return "modified"
    if before == "renamed" and now == "modified":
        return "renamed"
    return now


def _merged_column(before: Column, now: Column) -> Column:
    return (
        F.when(before.isNull(), now)
        .when((before == "created") & (now == "deleted"), F.lit(None).cast("string"))
        .when(before == "created", F.lit("created"))
        .when((before == "deleted") & (now == "created"), F.lit("modified"))
        .when((before == "renamed") & (now == "modified"), F.lit("renamed"))
        .otherwise(now)
    )


#: Kinds that may stand before a change; none stands for whatever undid itself.
KINDS = ("created", "deleted", "modified", "renamed")


def change_key(events: DataFrame) -> DataFrame:
    """events with the key that they coalesce by: a rename's both paths, so that it does not merge with changes of the new one."""
    return events.withColumn("key", F.when(F.col("kind") == "renamed", F.concat("old_path", F.lit("\u2192"), "path")).otherwise(F.col("path")))


def coalesced(events: DataFrame, key: str = "path", slice_: str = "hour", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, at, *keep) of events (key, kind, at, ord, *keep): one for each key that any change is left of; a key has one value of what is kept."""
    kept = [F.max(c).alias(c) for c in keep]
    none = F.lit(None).cast("string")
    step = lambda s, e: _merged_column(s, e["kind"])
    listed = events.groupBy(key, F.date_trunc(slice_, "at").alias("slice")).agg(F.sort_array(F.collect_list(F.struct("at", "ord", "kind"))).alias("x"), *kept)
    does = F.struct(F.aggregate("x", none, step).alias("none"), *[F.aggregate("x", F.lit(k), step).alias(k) for k in KINDS])
    maps = listed.select(key, "slice", does.alias("does"), F.element_at("x", -1)["at"].alias("at"), *keep)
    folded = maps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("slice", "at", "does"))).alias("y"), *kept)

    def follow(s, e):
        found = F.when(s.isNull(), e["does"]["none"])
        for kind in KINDS:
            found = found.when(s == kind, e["does"][kind])
        return found

    return folded.select(key, F.aggregate("y", none, follow).alias("kind"), F.element_at("y", -1)["at"].alias("at"), *keep).where("kind is not null")


def bulk_collapsed(merged_: DataFrame, most: int = BULK) -> DataFrame:
    """Changes (path, kind), one for each key (the column `key`, else the path), or one bulk_update with all their paths, sorted, where there are more than `most` keys.

    One event names them all, so a batch must be of bounded size: a stream's is (`watched`).
    """
    key = "key" if "key" in merged_.columns else "path"
    if merged_.select(key).distinct().limit(most + 1).count() <= most:
        return merged_.select("path", "kind", F.array("path").alias("paths"))
    return merged_.agg(F.lit(None).cast("string").alias("path"), F.lit("bulk_update").alias("kind"), F.sort_array(F.collect_list("path")).alias("paths"))


def settled(events: DataFrame, most: int = BULK) -> DataFrame:
    """(path, kind, paths): what a batch of events (path, old_path, kind, at, ord) comes to, merged by key first, then collapsed where it is large."""
    return bulk_collapsed(coalesced(change_key(events), "key", keep=("path",)), most)


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """(path, start, end, n): bursts of a path's events, the event-time form of a debounce."""
    return events.groupBy("path", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def classified(existing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, kind) by whether a path exists and is known."""
    both = existing.select("path", F.lit(True).alias("e")).join(known.select("path", F.lit(True).alias("k")), "path", "full_outer")
    return both.select("path", F.when(F.col("k").isNull(), "created").when(F.col("e").isNull(), "deleted").otherwise("modified").alias("kind"))


def actions(events: DataFrame) -> DataFrame:
    """(path, action): a rename deletes the old path and updates the new one."""
    one = lambda path, action: F.struct(F.col(path).alias("path"), F.lit(action).alias("action"))
    listed = F.when(F.col("kind") == "renamed", F.array(one("old_path", "delete"), one("path", "update"))).when(F.col("kind") == "deleted", F.array(one("path", "delete"))).otherwise(F.array(one("path", "update")))
    return events.select(F.explode(listed).alias("x")).select("x.*")


def coalesced_stream(events: DataFrame, quiet_ms: int = QUIET_MS, most_ms: int = MOST_MS, lateness: str = "1 minute") -> DataFrame:
    """(path, kind, at), the stream form: a key's fold is state, and leaves when it was quiet for quiet_ms or has waited most_ms.

    Where events have an old_path, a rename goes by both of its paths. Time is the events' own, behind a watermark, so that state is
    bounded and a replay gives the same rows.
    """
    keyed = change_key(events) if "old_path" in events.columns else events.withColumn("key", F.col("path"))

    def left(kind, path, last):
        return pd.DataFrame({"path": [path], "kind": [kind], "at": [pd.Timestamp(last, unit="ms")]})

    def step(key, frames: Iterator[pd.DataFrame], state):
        kind, path, first, last = state.get if state.exists else (None, None, None, None)
        if state.hasTimedOut:
            state.remove()
            if kind:
                yield left(kind, path, last)
            return
        rows = pd.concat(list(frames)).sort_values(["at", "ord"])
        path = rows["path"].iloc[0]
        for at, now in zip(rows["at"], rows["kind"]):
            ms = int(at.timestamp() * 1000)
            if last is not None and (ms - last > quiet_ms or ms - first > most_ms):
                if kind:
                    yield left(kind, path, last)
                kind, first = None, ms
            kind = merged(kind or None, now)
            first, last = ms if first is None else first, ms
        state.update((kind or "", path, first, last))
        state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))

    return keyed.withWatermark("at", lateness).groupBy("key").applyInPandasWithState(step, "path string, kind string, at timestamp", "kind string, path string, first long, last long", "append", "EventTimeTimeout")
