"""Queries that write to the stores and read back; each call takes a new folder in the shared one and leaves it there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.sources.sinks import VersionedTable, latest_version_at_most, marked_stale
from factloom.sources.snapshots import SnapshotStore

from .adapters import OVERLAY, overlay, read
from .registry import query
from .scratch import shared_folder


@query(f"WITH o AS ({OVERLAY}), e AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM o WHERE status = 'live') SELECT *, 3::BIGINT AS snapshot, (SELECT count(*) FROM orders) AS before, 2::BIGINT AS version FROM e")
def compacted_orders(spark, d):
    """A snapshot that is aborted, one that is committed, and a third of it and an overlay; the older ones are dropped, and a counter has moved twice."""
    store = SnapshotStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    broken = store.begin()
    store.write(broken, "orders", orders.where("o_orderkey % 2 = 0"))
    store.abort(broken)
    whole = store.begin()
    before = store.write(whole, "orders", orders, ("o_custkey",))["rows"]
    store.commit(whole)
    store.next("graph_version")
    snapshot, _ = store.compact("orders", overlay(spark, d), ["o_orderkey"], keep=1)
    store.next("graph_version")
    return store.read("orders").select("*", F.lit(snapshot).cast("long").alias("snapshot"), F.lit(before).cast("long").alias("before"), F.lit(store.current("graph_version")).cast("long").alias("version"))


@query("""WITH v AS (SELECT p_partkey AS id, p_retailprice AS score, p_brand AS score_name, 1::BIGINT AS graph_version FROM part WHERE p_brand <> 'Brand#11' UNION ALL SELECT p_partkey, p_size::DOUBLE, p_brand, 2::BIGINT FROM part WHERE p_size > 25)
SELECT id, score, score_name, graph_version, 'stale' AS status FROM v QUALIFY graph_version = max(graph_version) OVER (PARTITION BY score_name)""")
def stored_scores(spark, d):
    """Scores by name and version: two versions, the second written twice, one partition of the first dropped; of each name the newest up to version 5, marked stale."""
    table = VersionedTable(spark, f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}", ["score_name", "graph_version"])
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice", F.col("p_brand").alias("score_name"))
    version = lambda rows, score, n: rows.select("id", score.cast("double").alias("score"), "score_name", F.lit(n).cast("long").alias("graph_version"))
    table.upsert(version(part, F.col("p_retailprice"), 1))
    table.upsert(version(part.where("p_size > 25"), F.lit(0.0), 2))
    table.upsert(version(part.where("p_size > 25"), F.col("p_size"), 2))
    table.delete(score_name="Brand#11", graph_version=1)
    kept = table.read().withColumn("graph_version", F.col("graph_version").cast("long"))
    return marked_stale(latest_version_at_most(kept, "score_name", 5)).select("id", "score", "score_name", "graph_version", "status")
