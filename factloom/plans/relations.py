"""Queries on versions, differences, filters and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import lookups, policy, resolve, versioned

from .adapters import OVERLAY, overlay, read
from .registry import query

_SNAPSHOTS = "SELECT year(o_orderdate) * 100 + month(o_orderdate) AS snapshot_id, CASE WHEN min(o_orderstatus) = 'P' THEN 'pending' ELSE 'committed' END AS status, count(*) AS n FROM orders GROUP BY 1"


def _snapshots(spark, d):
    return read(spark, d, "orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long").alias("snapshot_id")).agg(F.when(F.min("o_orderstatus") == "P", "pending").otherwise("committed").alias("status"), F.count("*").alias("n"))


@query(f"SELECT coalesce(max(snapshot_id), 0)::BIGINT AS snapshot_id FROM ({_SNAPSHOTS}) WHERE status = 'committed'")
def latest_snapshot(spark, d):
    return versioned.latest_committed(_snapshots(spark, d))


@query(f"WITH o AS ({OVERLAY}) SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM o WHERE status = 'live'")
def effective_orders(spark, d):
    return versioned.effective(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), overlay(spark, d), ["o_orderkey"])


@query(f"SELECT DISTINCT o_custkey FROM ({OVERLAY}) WHERE write_epoch > 1200")
def changed_keys_since_epoch(spark, d):
    return versioned.changed_since(overlay(spark, d), "o_custkey", 1200)


@query(f"SELECT o_custkey, max_by(o_orderkey, (write_epoch, o_orderkey)) AS o_orderkey, max(write_epoch) AS write_epoch FROM ({OVERLAY}) GROUP BY 1")
def upserts_on_read(spark, d):
    own = overlay(spark, d).select("o_custkey", "o_orderkey", "write_epoch")
    return versioned.newest_per_key(own, ["o_custkey"])


@query(f"WITH o AS ({OVERLAY}) SELECT coalesce(name, 'all') AS name, sum(n)::BIGINT AS n FROM (SELECT 'live' AS name, count(*) AS n FROM o WHERE status = 'live' UNION ALL SELECT 'deleted', count(*) FROM o WHERE status = 'deleted' UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'parts', count(*) FROM part) GROUP BY ROLLUP (name)")
def overlay_row_counts(spark, d):
    own = overlay(spark, d)
    return lookups.row_counts({"live": own.where("status = 'live'"), "deleted": own.where("status = 'deleted'"), "orders": read(spark, d, "orders"), "parts": read(spark, d, "part")})


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5")
def retention_keep_n(spark, d):
    return versioned.retained(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), 5, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


_WRITTEN = "SELECT l_suppkey AS src, l_partkey % 50 AS dst, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS ordinal, CASE WHEN l_linenumber = 1 AND l_orderkey % 97 = 0 THEN 'lsp.call' ELSE 'comment.text' END AS source, CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.6 END::DOUBLE AS confidence, l_linestatus = 'O' AS validated FROM lineitem"


@query(f"""WITH e AS ({_WRITTEN}),
m AS (SELECT *, max(CASE WHEN source LIKE 'lsp%' THEN ordinal END) OVER (PARTITION BY src, kind) AS lt, min(CASE WHEN source LIKE 'lsp%' AND validated AND confidence >= 1 THEN ordinal END) OVER (PARTITION BY src, dst, kind) AS lf FROM e)
SELECT src, dst, kind, ordinal, source, confidence, validated FROM m WHERE source LIKE 'lsp%' OR ((lt IS NULL OR ordinal > lt) AND (lf IS NULL OR ordinal < lf)) QUALIFY row_number() OVER (PARTITION BY src, dst, kind ORDER BY ordinal DESC) = 1""")
def priority_merge_edges(spark, d):
    items = read(spark, d, "lineitem")
    written = items.select(
        F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 97 == 0), "lsp.call").otherwise("comment.text").alias("source"), F.when(F.col("l_discount") < 0.05, 1.0).otherwise(0.6).alias("confidence"), (F.col("l_linestatus") == "O").alias("validated"),
    )
    return versioned.priority_merge(written)


_KNOWN = "SELECT p_partkey AS path, p_size AS hash FROM part WHERE p_partkey % 7 <> 0"
_SEEN = "SELECT p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS hash FROM part WHERE p_partkey % 5 <> 0"


@query(f"SELECT path, CASE WHEN k.hash IS NULL THEN 'created' WHEN s.hash IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM ({_KNOWN}) k FULL JOIN ({_SEEN}) s USING (path) WHERE k.hash IS DISTINCT FROM s.hash")
def manifest_diff(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("hash"))
    seen = part.where("path % 5 <> 0").select("path", F.when(F.col("path") % 11 == 0, F.col("hash") + 1).otherwise(F.col("hash")).alias("hash"))
    return versioned.manifest_diff(part.where("path % 7 <> 0"), seen)


@query("""WITH a AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 9 <> 0), b AS (SELECT c_custkey AS id, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 8 <> 0)
SELECT id, CASE WHEN a.c_nationkey IS NULL THEN 'added' WHEN b.c_nationkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (id) WHERE a.c_nationkey IS DISTINCT FROM b.c_nationkey OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def symbol_diff(spark, d):
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    now = own.where("id % 8 <> 0").withColumn("c_mktsegment", F.when(F.col("id") % 4 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return versioned.row_diff(own.where("id % 9 <> 0"), now, ["id"], ["c_nationkey", "c_mktsegment"])


@query("SELECT count(*) AS n, count_if(o_orderstatus = 'O') AS stale, round(count_if(o_orderstatus = 'O') / count(*), 9) AS ratio FROM orders")
def stale_ratio(spark, d):
    scores = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "stale").otherwise("exact").alias("status"))
    return lookups.stale_ratio(scores).withColumn("ratio", F.round("ratio", 9))


@query("SELECT n_name AS path, max(c_acctbal) AS score, max(c_custkey % 7) AS graph_version, count(*) AS symbols FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1 ORDER BY score DESC, path LIMIT 10")
def ranked_files(spark, d):
    status = F.when(F.col("c_mktsegment") == "BUILDING", "exact").when(F.col("c_mktsegment") == "MACHINERY", "approximate").otherwise("stale")
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_nationkey").alias("file_id"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 7).alias("graph_version"), status.alias("status"))
    files = read(spark, d, "nation").select(F.col("n_nationkey").alias("file_id"), F.col("n_name").alias("path"))
    return lookups.ranked_paths(own.select("symbol_id", "score", "graph_version", "status"), own.select("symbol_id", "file_id"), files, 10)


@query("SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 WHEN 4 THEN 0.6 WHEN 5 THEN 0.45 WHEN 6 THEN 0.2 END::DOUBLE AS confidence, CASE WHEN p_retailprice / 1000 >= 1 THEN 0.95 WHEN p_retailprice / 1000 >= 0.8 THEN 0.8 WHEN p_retailprice / 1000 >= 0.6 THEN 0.7 ELSE 0.45 END::DOUBLE AS impact FROM part")
def confidence_ladder(spark, d):
    tier = F.element_at(F.array(*[F.lit(x) for x in [*resolve.RUNGS, "none"]]), F.col("p_size") % 8 + 1)
    return read(spark, d, "part").select("p_partkey", resolve.confidence_of(tier).alias("confidence"), scalars.impact_confidence(F.col("p_retailprice") / 1000).alias("impact"))


@query("SELECT l_orderkey, l_linenumber, round(CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.8 ELSE 0.5 END * CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.9 END * (1 - l_tax) * (1 - l_discount), 9) AS weight FROM lineitem")
def edge_weight_product(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.8).otherwise(0.5)
    weight = resolve.edge_weight(kind, F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.9), 1 - F.col("l_tax"), 1 - F.col("l_discount"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(weight, 9).alias("weight"))


@query("SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(url, '^[a-z]+://', ''), '[/\\\\.-]+'), lambda x: x <> '').list_aggregate('string_agg', ' ') AS tokens FROM pages")
def url_path_tokens(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(scalars.path_tokens(F.regexp_replace("url", "^[a-z]+://", "")), " ").alias("tokens"))


@query("SELECT doc_id, floor(octet_length(encode(coalesce(text, ''))) / 4)::BIGINT AS cost FROM documents")
def token_cost(spark, d):
    return read(spark, d, "documents").select("doc_id", scalars.token_cost(F.coalesce("text", F.lit(""))).alias("cost"))


@query("""WITH n AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS w, lower(replace(p_type, '_', '')) AS t FROM part)
SELECT p_partkey, array_to_string(CASE WHEN len(w) > 1 THEN list_concat([array_to_string(w, '')], w) ELSE w END, ' ') AS camel, p_partkey || '-x_' || t || ' ' || p_partkey || ' x ' || t AS mixed FROM n""")
def identifier_tokens(spark, d):
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    mixed = F.concat(F.col("p_partkey").cast("string"), F.lit("-x_"), F.lower(F.replace("p_type", F.lit("_"), F.lit(""))))
    return read(spark, d, "part").select("p_partkey", F.array_join(scalars.identifier_tokens(camel), " ").alias("camel"), F.array_join(scalars.identifier_tokens(mixed), " ").alias("mixed"))


@query("""WITH i AS (SELECT o_custkey AS k, l_orderkey * 10 + l_linenumber AS interval_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS low, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS high FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT o_custkey AS k, o_orderkey AS point_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 3 AS moment FROM orders)
SELECT point_id, interval_id, (high - low)::INT AS size FROM p JOIN i USING (k) WHERE moment BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY high - low, interval_id) = 1""")
def innermost_interval(spark, d):
    from factloom.operators.retrieval import innermost

    day = lambda c: F.datediff(c, F.lit("1990-01-01"))
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), day("o_orderdate").alias("low"))
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day("l_shipdate").alias("high"))
    intervals = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("k", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("interval_id"), "low", "high")
    return innermost(orders.select("k", F.col("o_orderkey").alias("point_id"), (F.col("low") + 3).alias("at")), intervals, "k")


@query("SELECT o_orderpriority, o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 50")
def priority_lanes(spark, d):
    return policy.lanes(read(spark, d, "orders"), 50, "o_orderpriority", (F.desc("o_totalprice"), F.asc("o_orderkey"))).select("o_orderpriority", "o_orderkey", "o_custkey")
