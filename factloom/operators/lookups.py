"""Looking facts up in their snapshot: by key, by name, by folder, by newest state. All lookups are batched joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import glob_regex

#: Visibilities by how far they reach; whatever else is said is unknown.
VISIBILITIES = ("exported", "public", "protected", "package", "private")
#: States of a score that may be shown.
USABLE = ("exact", "approximate")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def newest_snapshots(snapshots: DataFrame, by: str = "repo") -> DataFrame:
    """(by, snapshot_id): the greatest committed snapshot of each repository."""
    return snapshots.where("status = 'committed'").groupBy(by).agg(F.max("snapshot_id").alias("snapshot_id"))


def of_newest_snapshot(facts: DataFrame, snapshots: DataFrame, by: str = "repo") -> DataFrame:
    """Facts (repo, snapshot_id, ...) of their repository's newest committed snapshot."""
    return facts.join(newest_snapshots(snapshots, by), [by, "snapshot_id"], "left_semi")


def ordered_symbols(symbols: DataFrame, files: DataFrame, snapshot: int, most: int | None = None) -> DataFrame:
    """(symbol_id, path, ...) of one snapshot by symbol_id; a symbol without a file stays. `most` stops the scan early."""
    own = symbols.where(F.col("snapshot_id") == snapshot)
    joined = own.join(files.select("snapshot_id", "file_id", "path"), ["snapshot_id", "file_id"], "left").orderBy("symbol_id")
    return joined if most is None else joined.limit(most)


def looked_up(wanted: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """wanted with the value that a table holds for each key, null where it holds none; the smallest where it holds several."""
    return wanted.join(table.groupBy(key).agg(F.min(value).alias(value)), key, "left")


def locations(wanted: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(stable_key, path, line) of keys that have a symbol in a known file."""
    own = symbols.select("stable_key", "file_id", "line").join(wanted.select("stable_key").distinct(), "stable_key", "left_semi")
    return own.join(files.select("file_id", "path"), "file_id").select("stable_key", "path", "line")


def symbols_named(wanted: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """(path, name, stable_key, overflow): of each wanted (path, name) the first keys, and whether there are more than `most`."""
    met = symbols.join(wanted.select("path", "name").distinct(), ["path", "name"], "left_semi")
    place = F.row_number().over(Window.partitionBy("path", "name").orderBy("stable_key"))
    first = met.select("path", "name", "stable_key", place.alias("n")).where(F.col("n") <= most + 1)
    more = F.max("n").over(Window.partitionBy("path", "name")) > most
    return first.withColumn("overflow", more).where(F.col("n") <= most).drop("n")


def usable_scores(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("status").isin(*USABLE))


def ranked_paths(scores: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 0) -> DataFrame:
    """(path, score, graph_version, symbols), the best first: the greatest usable score of each file's symbols; most = 0: all."""
    joined = usable_scores(scores).join(symbols.select("symbol_id", "file_id"), "symbol_id").join(files.select("file_id", "path"), "file_id")
    best = joined.groupBy("path").agg(F.max("score").alias("score"), F.max("graph_version").alias("graph_version"), F.count("*").alias("symbols")).orderBy(F.desc("score"), "path")
    return best.limit(most) if most else best


def members_now(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, cluster, symbol_id, name): cluster members as the newest snapshot of their repository names them."""
    last = symbols.groupBy("repo").agg(F.max("snapshot_id").alias("snapshot_id"))
    own = symbols.join(last, ["repo", "snapshot_id"], "left_semi").select("repo", "symbol_id", "name")
    return members.join(own, ["repo", "symbol_id"]).select("repo", "cluster", "symbol_id", "name")


def prior_facts(overlay: DataFrame, base: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(key, facts, origin): of each key the newest live overlay row, else the row of the greatest snapshot."""
    best = lambda rows, at: rows.groupBy(key).agg(F.max(F.struct(F.col(at).alias("_at"), *facts)).alias("x")).select(key, "x")
    first = best(overlay.where("status = 'live'"), "write_epoch").withColumnRenamed("x", "o")
    both = first.join(best(base, "snapshot_id").withColumnRenamed("x", "b"), key, "full_outer")
    return both.select(key, *[F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in facts], F.when(F.col("o").isNotNull(), "overlay").otherwise("snapshot").alias("origin"))


def candidate_paths(overlay: DataFrame, every: DataFrame, epoch: int) -> DataFrame:
    """Paths that changed since an epoch, or all paths where none did. The choice is made by a count of one row."""
    changed = overlay.where(F.col("write_epoch") > epoch).select("path").distinct()
    none = changed.agg((F.count("*") == 0).alias("_none"))
    return changed.union(every.select("path").distinct().join(F.broadcast(none)).where("_none").select("path"))


def listing(paths: DataFrame, folder: str) -> DataFrame:
    """(name, kind, size, entries): what stands directly in a folder; a sub-folder has the size of all below it."""
    lead = folder.rstrip("/") + "/" if folder else ""
    rest = F.substring("path", len(lead) + 1, 1 << 30)
    name, kind = F.substring_index(rest, "/", 1), F.when(rest.contains("/"), "folder").otherwise("file")
    return paths.where(F.col("path").startswith(lead) & (F.length("path") > len(lead))).groupBy(name.alias("name"), kind.alias("kind")).agg(F.sum("size").alias("size"), F.count("*").alias("entries"))


def named_like(path, include: str | None = None, exclude: str | None = None) -> Column:
    """Whether the base name of a path matches one glob and not the other."""
    base = F.regexp_extract(_col(path), "([^/]*)$", 1)
    inside = base.rlike(glob_regex(include)) if include else F.lit(True)
    return inside & ~base.rlike(glob_regex(exclude)) if exclude else inside


def visibility(raw) -> Column:
    """A closed set of visibilities; anything else, null too, is unknown."""
    return F.when(_col(raw).isin(*VISIBILITIES), _col(raw)).otherwise("unknown")


def publicly_visible(raw) -> Column:
    return F.coalesce(_col(raw).isin("exported", "public", "protected"), F.lit(False))


def first_with_total(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """rows, the first `most` of each group in order, with the group's total and whether some are left out."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n").join(counted, by).withColumn("truncated", F.col("total") > most)


def by_score_and_version(rows: DataFrame, most: int) -> DataFrame:
    """The best rows (id, score, graph_version): by score, then the newer version, then the id."""
    return rows.orderBy(F.desc("score"), F.desc("graph_version"), "id").limit(most)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables, and their sum under the name `all`."""
    each = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    whole = each[0]
    for x in each[1:]:
        whole = whole.union(x)
    return whole.rollup("name").agg(F.sum("n").alias("n")).select(F.coalesce("name", F.lit("all")).alias("name"), "n")


def stale_ratio(scores: DataFrame) -> DataFrame:
    """(n, stale, ratio) of scores by status; 0 where there are none."""
    counts = scores.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "stale").alias("stale"))
    return counts.select("n", "stale", F.when(F.col("n") > 0, F.col("stale") / F.col("n")).otherwise(0.0).alias("ratio"))
