"""What a change does to the graph: tombstones, repairs, their application, and the policies that say when."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scheduler's quiet time and idle time in milliseconds, the share of stale scores that calls for all ranks,
#: and the waits of a compaction.
QUIET_MS, IDLE_MS, STALE_SHARE = 2_000, 60_000, 0.25
COMPACT_IDLE_MS, COMPACT_WAIT_MS = 60_000, 300_000


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def symbol_tombstones(symbols: DataFrame, gone: DataFrame, epoch: int) -> DataFrame:
    """Rows that delete the symbols of gone files (file_id)."""
    held = symbols.join(gone.select("file_id").distinct(), "file_id", "left_semi")
    return held.withColumn("status", F.lit("deleted")).withColumn("write_epoch", F.lit(epoch).cast("long"))


def edge_tombstones(edges: DataFrame, gone: DataFrame, epoch: int) -> DataFrame:
    """Rows that delete the edges (src, dst, kind) with a gone end (id): two equi-joins, of which the second leaves out what the first has."""
    ids = gone.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    return out.unionByName(into).withColumn("status", F.lit("deleted")).withColumn("write_epoch", F.lit(epoch).cast("long"))


def pending_repairs(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, action) that tombstones call for: remove the nodes of deleted symbols (id), look again at the ends of deleted edges.

    A node that goes is not dirty as well; live rows call for nothing.
    """
    gone = symbols.where("status = 'deleted'").select("id").distinct()
    ends = edges.where("status = 'deleted'").select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    return gone.withColumn("action", F.lit("remove")).union(ends.join(gone, "id", "left_anti").withColumn("action", F.lit("dirty")))


def applied(edges: DataFrame, repair: DataFrame, fresh: DataFrame, version: int) -> DataFrame:
    """Edges (src, dst, kind, graph_version) after a repair (id, action): those at removed nodes go, fresh ones replace their equals.

    The version moves on by one where the repair or the fresh edges hold anything, and stays where they do not.
    """
    gone = repair.where("action = 'remove'").select("id").distinct()
    at = lambda end: gone.withColumnRenamed("id", end)
    clean = lambda rows: rows.select("src", "dst", "kind").join(at("src"), "src", "left_anti").join(at("dst"), "dst", "left_anti")
    kept = clean(edges).join(fresh.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    some = repair.select(F.lit(1).alias("one")).union(fresh.select(F.lit(1))).agg((F.lit(version) + F.when(F.count("*") > 0, 1).otherwise(0)).cast("long").alias("graph_version"))
    return kept.unionByName(clean(fresh).distinct()).join(F.broadcast(some)).select("src", "dst", "kind", "graph_version")


def file_diff(prior: DataFrame, current: DataFrame, files: DataFrame) -> DataFrame:
    """(path, id, change, tier) of files (path, status): what an extraction says about each.

    A ready one with prior facts gives the whole difference, a partial one only what it adds, any other a single
    `changed` without an id and the reason for it, so that every file that was looked at leaves a row.
    """
    known = prior.select("path").distinct().withColumn("_known", F.lit(True))
    held = files.join(known, "path", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    full, partial = (F.col("status") == "ready") & F.col("_known"), F.col("status") == "partial"
    tier = F.when(full, "full").when(partial, "added_only").when(F.col("status") == "failed", "extract_failed").when(F.col("status") == "unsupported", "extract_unsupported").otherwise("cold_start")
    tiers = held.select("path", tier.alias("tier"))
    old, new = prior.select("path", "id", F.col("hash").alias("_old")), current.select("path", "id", F.col("hash").alias("_new"))
    both = old.join(new, ["path", "id"], "full_outer").join(tiers.where("tier = 'full'"), "path")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    whole = both.select("path", "id", change.alias("change"), "tier").where("change is not null")
    added = current.join(tiers.where("tier = 'added_only'"), "path").select("path", "id", F.lit("added").alias("change"), "tier")
    marks = tiers.where("tier not in ('full', 'added_only')").select("path", F.lit(None).cast("long").alias("id"), F.lit("changed").alias("change"), "tier")
    return whole.union(added).union(marks)


def _first_of(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, or null."""
    return F.coalesce(*[F.when(on, F.lit(name)) for name, on in checks])


def compaction_block(pending_rows, idle_ms, edits, writers, enriching, waited_ms, ranking, after_idle: int = COMPACT_IDLE_MS, most_wait: int = COMPACT_WAIT_MS) -> Column:
    """The first reason, in order, that holds a compaction back; null: it may run. A change that never came (null idle_ms) is idle."""
    return _first_of([
        ("overlay_empty", _col(pending_rows) == 0), ("idle_too_short", F.coalesce(_col(idle_ms) < after_idle, F.lit(False))), ("edit_tx_active", _col(edits) > 0),
        ("overlay_tx_active", _col(writers) > 0), ("lsp_pending", (_col(enriching) > 0) & (_col(waited_ms) < most_wait)), ("rank_repairing", _col(ranking)),
    ])


def rank_step(since_change_ms, idle_ms, stale, total) -> Column:
    """What ranks need: `local` once changes have been quiet, `all` after a long idle time with a large stale share, else `none`."""
    due = (_col(total) > 0) & (_col(stale) / F.nullif(_col(total), F.lit(0)) >= STALE_SHARE) & (_col(idle_ms) >= IDLE_MS)
    return F.when(F.coalesce(_col(since_change_ms) >= QUIET_MS, F.lit(False)), "local").when(F.coalesce(due, F.lit(False)), "all").otherwise("none")


def index_state(indexed, latest) -> Column:
    """Whether a text index is of the newest snapshot: `current`, `rebuild` (behind, ahead or never built), or `nothing` to index."""
    built = F.coalesce(_col(indexed), F.lit(0))
    return F.when(F.coalesce(_col(latest), F.lit(0)) == 0, "nothing").when(built == _col(latest), "current").otherwise("rebuild")


def in_lanes(waiting: DataFrame, lanes: list[str], most: int) -> DataFrame:
    """The next items (lane, at, item): all of an earlier lane before any of a later one, by time within; unknown lanes last."""
    rank = reduce(lambda c, x: c.when(F.col("lane") == x[1], x[0]), list(enumerate(lanes))[1:], F.when(F.col("lane") == lanes[0], 0)).otherwise(len(lanes))
    return waiting.orderBy(rank, "at", "item").limit(most)
