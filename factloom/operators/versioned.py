"""Snapshots, overlays and what changed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_committed(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("status = 'committed'").agg(F.coalesce(F.max("snapshot_id"), F.lit(0).cast("long")).alias("snapshot_id"))


def newest_per_key(delta: DataFrame, key: list[str], epoch: str = "write_epoch") -> DataFrame:
    """Upserts on read: of each key the row of the highest epoch, by a pre-aggregated maximum rather than a sort."""
    rest = [c for c in delta.columns if c not in key]
    best = delta.groupBy(*key).agg(F.max(F.struct(F.col(epoch).alias("_e"), *rest)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(delta.columns)


def effective(base: DataFrame, overlay: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    """Merge on read: an overlay row replaces its base row, and a deleted one removes it."""
    kept = base.join(overlay.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(overlay.where(F.col(status) == "live").select(base.columns))


def changed_since(overlay: DataFrame, key: str, epoch: int) -> DataFrame:
    return overlay.where(F.col("write_epoch") > epoch).select(key).distinct()


def cleared(overlay: DataFrame, epoch: int) -> DataFrame:
    return overlay.where(F.col("write_epoch") > epoch)


def retained(snapshots: DataFrame, keep: int, by: str, order: list) -> DataFrame:
    """The newest `keep` of each group."""
    return snapshots.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def priority_merge(edges: DataFrame) -> DataFrame:
    """Edges (ordinal, src, dst, kind, source, confidence, validated) after they were written one by one.

    A tool's edge (source `lsp...`) removes the comments' edges of its (src, kind) that came before; a comment's
    edge is dropped where a validated tool edge of full confidence for the same (src, dst, kind) came before.
    Of equal (src, dst, kind) the last that was written stays.
    """
    tool = F.col("source").startswith("lsp")
    last_tool = F.max(F.when(tool, F.col("ordinal"))).over(Window.partitionBy("src", "kind"))
    first_firm = F.min(F.when(tool & F.col("validated") & (F.col("confidence") >= 1), F.col("ordinal"))).over(Window.partitionBy("src", "dst", "kind"))
    marked = edges.withColumn("_tool", last_tool).withColumn("_firm", first_firm)
    survives = tool | ((F.col("_tool").isNull() | (F.col("ordinal") > F.col("_tool"))) & (F.col("_firm").isNull() | (F.col("ordinal") < F.col("_firm"))))
    rest = [c for c in edges.columns if c not in ("src", "dst", "kind")]
    last = marked.where(survives).groupBy("src", "dst", "kind").agg(F.max(F.struct("ordinal", *[c for c in rest if c != "ordinal"])).alias("_x"))
    return last.select("src", "dst", "kind", *[F.col(f"_x.{c}").alias(c) for c in rest]).select(edges.columns)


def manifest_diff(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, change): created, modified or deleted; what is as it was is left out."""
    both = known.withColumnRenamed("hash", "_old").join(seen.withColumnRenamed("hash", "_new"), "path", "full_outer")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def row_diff(prior: DataFrame, current: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """Keys that were added, removed or changed; nulls are equal to nulls."""
    old = prior.select(*key, F.struct(*compared).alias("_old"))
    new = current.select(*key, F.struct(*compared).alias("_new"))
    both = old.join(new, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def repair_sets(diff: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(id, action): removed and added nodes, and the neighbours that they make dirty."""
    touched = diff.select(F.col(node).alias("id"), F.when(F.col("change") == "removed", "remove").otherwise("upsert").alias("action"))
    near = edges.join(touched.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).union(edges.join(touched.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")))
    return touched.union(near.distinct().join(touched, "id", "left_anti").withColumn("action", F.lit("dirty")))
