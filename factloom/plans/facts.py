"""Queries on facts in their snapshots, on files, and on the upkeep of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import api
from factloom.functions import scalars
from factloom.operators import lookups, policy, repairs, versioned
from factloom.sources import files, sinks

from .adapters import LINKS, OVERLAY, links, overlay, read
from .registry import query

_VERSIONED = "SELECT o_orderpriority AS repo, year(o_orderdate) * 100 + month(o_orderdate) AS snapshot_id, o_orderkey AS symbol_id, o_custkey AS file_id FROM orders"
_MANIFEST = f"SELECT repo, snapshot_id, CASE WHEN snapshot_id % 3 = 0 THEN 'pending' ELSE 'committed' END AS status FROM (SELECT DISTINCT repo, snapshot_id FROM ({_VERSIONED}))"


def _versioned(spark, d):
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("repo"), month.alias("snapshot_id"), F.col("o_orderkey").alias("symbol_id"), F.col("o_custkey").alias("file_id"))


def _manifest(spark, d):
    return _versioned(spark, d).select("repo", "snapshot_id").distinct().withColumn("status", F.when(F.col("snapshot_id") % 3 == 0, "pending").otherwise("committed"))


@query(f"WITH v AS ({_VERSIONED}) SELECT symbol_id, c_name AS path FROM v LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON file_id = c_custkey WHERE snapshot_id = 199601")
def snapshot_symbols(spark, d):
    known = read(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.lit(199601).cast("long").alias("snapshot_id"), F.col("c_custkey").alias("file_id"), F.col("c_name").alias("path"))
    return lookups.ordered_symbols(_versioned(spark, d), known, 199601).select("symbol_id", "path")


@query(f"WITH v AS ({_VERSIONED}), m AS ({_MANIFEST}) SELECT v.* FROM v JOIN (SELECT repo, max(snapshot_id) AS snapshot_id FROM m WHERE status = 'committed' GROUP BY 1) USING (repo, snapshot_id)")
def newest_snapshot_facts(spark, d):
    return lookups.of_newest_snapshot(_versioned(spark, d), _manifest(spark, d))


@query("SELECT p_partkey * 2 AS id, p_size, c_name FROM part LEFT JOIN (SELECT c_custkey, c_name FROM customer) ON c_custkey = p_partkey * 2")
def key_lookup(spark, d):
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return lookups.looked_up(read(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"), "p_size"), names, "id", "c_name")


_SYMBOLS = "SELECT p_brand AS path, p_type AS name, p_name || p_partkey AS stable_key FROM part"


def _symbols(spark, d):
    return read(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("name"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("stable_key"), (F.col("p_partkey") % 50).alias("file_id"), F.col("p_size").alias("line"))


@query(f"WITH s AS ({_SYMBOLS}) SELECT path, name, stable_key, count(*) OVER (PARTITION BY path, name) > 5 AS overflow FROM s WHERE path <> 'Brand#3' QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY stable_key) <= 5")
def symbols_by_name(spark, d):
    own = _symbols(spark, d)
    return lookups.symbols_named(own.where("path <> 'Brand#3'").select("path", "name"), own)


@query("SELECT p_name || p_partkey AS stable_key, s_name AS path, p_size AS line FROM part JOIN supplier ON p_partkey % 50 = s_suppkey WHERE p_size % 2 = 0")
def symbol_locations(spark, d):
    own = _symbols(spark, d)
    known = read(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("path"))
    return lookups.locations(own.where("line % 2 = 0").select("stable_key"), own, known)


_RAW = ("exported", "public", "protected", "package", "private", "Public", "internal")


@query(f"SELECT p_partkey, CASE WHEN p_size % 8 < 5 THEN {list(_RAW)}[p_size % 8 + 1] ELSE 'unknown' END AS visibility, p_size % 8 < 3 AS public FROM part")
def visibility_classes(spark, d):
    raw = F.get(F.array(*[F.lit(x) for x in _RAW]), F.col("p_size") % 8)
    return read(spark, d, "part").select("p_partkey", lookups.visibility(raw).alias("visibility"), lookups.publicly_visible(raw).alias("public"))


@query("SELECT page_id, regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^[0-9][^/]*$') AND NOT regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^[^/]*[?][^/]*$') AS named FROM pages")
def base_name_filter(spark, d):
    return read(spark, d, "pages").select("page_id", lookups.named_like("url", "[0-9]*", "*[?]*").alias("named"))


@query(f"WITH v AS ({_VERSIONED}), n AS (SELECT repo, max(snapshot_id) AS s FROM v GROUP BY 1), m AS (SELECT DISTINCT repo, symbol_id, file_id % 10 AS cluster FROM v) SELECT m.repo, cluster, m.symbol_id, 'f' || file_id AS name FROM m JOIN v ON v.repo = m.repo AND v.symbol_id = m.symbol_id JOIN n ON n.repo = v.repo AND s = snapshot_id")
def cluster_members_now(spark, d):
    own = _versioned(spark, d)
    members = own.select("repo", "symbol_id", (F.col("file_id") % 10).alias("cluster")).distinct()
    return lookups.members_now(members, own.select("repo", "snapshot_id", "symbol_id", F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("name")))


@query(f"WITH o AS (SELECT o_custkey AS path, max_by(o_totalprice, (write_epoch, o_totalprice)) AS price FROM ({OVERLAY}) WHERE status = 'live' GROUP BY 1), b AS (SELECT o_custkey AS path, max_by(o_totalprice, (o_orderkey, o_totalprice)) AS price FROM orders GROUP BY 1) SELECT path, round(coalesce(o.price, b.price), 2) AS price, CASE WHEN o.price IS NULL THEN 'snapshot' ELSE 'overlay' END AS origin FROM o FULL JOIN b USING (path)")
def prior_file_facts(spark, d):
    live = overlay(spark, d).select(F.col("o_custkey").alias("path"), F.col("o_totalprice").alias("price"), "status", "write_epoch")
    base = read(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("snapshot_id"))
    return lookups.prior_facts(live, base, "path", ["price"]).select("path", F.round("price", 2).alias("price"), "origin")


@query(f"SELECT 'since' AS run, o_custkey AS path FROM (SELECT DISTINCT o_custkey FROM ({OVERLAY}) WHERE write_epoch > 1200) UNION ALL SELECT 'all', c_custkey FROM customer")
def candidate_paths(spark, d):
    own, every = overlay(spark, d).withColumnRenamed("o_custkey", "path"), read(spark, d, "customer").select(F.col("c_custkey").alias("path"))
    tagged = lambda run, epoch: lookups.candidate_paths(own, every, epoch).select(F.lit(run).alias("run"), "path")
    return tagged("since", 1200).union(tagged("all", 1_000_000))


_PATHS = "SELECT regexp_replace(url, '^[a-z]+://', '') AS path, length(html) AS size FROM pages"


def _paths(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.length("html").alias("size"), F.col("html").alias("content"))


@query(f"WITH p AS ({_PATHS}) SELECT split_part(path, '/', 1) AS name, CASE WHEN contains(path, '/') THEN 'folder' ELSE 'file' END AS kind, sum(size)::BIGINT AS size, count(*) AS entries FROM p GROUP BY ALL")
def folder_listing(spark, d):
    return lookups.listing(_paths(spark, d), "")


@query(f"WITH e AS ({LINKS}) SELECT dst, src, count(*) OVER (PARTITION BY dst) AS total, count(*) OVER (PARTITION BY dst) > 3 AS truncated FROM e QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 3")
def callers_limited(spark, d):
    return lookups.first_with_total(links(spark, d), ["dst"], [F.asc("src")], 3).select("dst", "src", "total", "truncated")


@query("SELECT c_custkey AS id, round(c_acctbal / 1000) AS score, c_custkey % 5 AS graph_version FROM customer ORDER BY score DESC, graph_version DESC, id LIMIT 40")
def versions_break_ties(spark, d):
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") / 1000).alias("score"), (F.col("c_custkey") % 5).alias("graph_version"))
    return lookups.by_score_and_version(own, 40)


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'exact' ELSE 'approximate' END AS status FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def usable_scores(spark, d):
    status = F.when(F.col("c_mktsegment") == "BUILDING", "exact").when(F.col("c_mktsegment") == "MACHINERY", "approximate").when(F.col("c_mktsegment") == "FURNITURE", "missing").otherwise("stale")
    return lookups.usable_scores(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), status.alias("status")))


_GONE = "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0"


def _gone(spark, d):
    return read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))


@query(f"WITH g AS ({_GONE}) SELECT src, dst, 'deleted' AS status, 77::BIGINT AS write_epoch FROM ({LINKS}) WHERE src IN (SELECT id FROM g) OR dst IN (SELECT id FROM g)")
def edge_tombstones(spark, d):
    return repairs.edge_tombstones(links(spark, d), _gone(spark, d), 77)


@query("SELECT o_orderkey AS symbol, o_custkey AS file_id, 'deleted' AS status, 78::BIGINT AS write_epoch FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def symbol_tombstones(spark, d):
    own = read(spark, d, "orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_custkey").alias("file_id"))
    return repairs.symbol_tombstones(own, _gone(spark, d).withColumnRenamed("id", "file_id"), 78)


_DEAD = f"SELECT src, dst FROM ({LINKS}) WHERE dst % 10 = 0"


@query(f"WITH g AS ({_GONE}), d AS ({_DEAD}) SELECT id, 'remove' AS action FROM g UNION ALL SELECT id, 'dirty' FROM (SELECT src AS id FROM d UNION SELECT dst FROM d) WHERE id NOT IN (SELECT id FROM g)")
def pending_repairs(spark, d):
    gone = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "deleted").otherwise("live").alias("status"))
    return repairs.pending_repairs(gone, links(spark, d).withColumn("status", F.when(F.col("dst") % 10 == 0, "deleted").otherwise("live")))


@query(f"WITH g AS ({_GONE}), e AS (SELECT src, dst, 'CALLS' AS kind FROM ({LINKS}) UNION SELECT c_custkey, c_custkey + 1, 'CALLS' FROM customer) SELECT src, dst, kind, 42::BIGINT AS graph_version FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)")
def applied_repair(spark, d):
    fresh = read(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"), F.lit("CALLS").alias("kind"))
    return repairs.applied(links(spark, d).withColumn("kind", F.lit("CALLS")), _gone(spark, d).withColumn("action", F.lit("remove")), fresh, 41)


@query(f"SELECT src, dst, 'CALLS' AS kind, 41::BIGINT AS graph_version FROM ({LINKS})")
def empty_repair(spark, d):
    edges = links(spark, d).withColumn("kind", F.lit("CALLS"))
    return repairs.applied(edges, _gone(spark, d).withColumn("action", F.lit("remove")).where("id < 0"), edges.where("src < 0"), 41)


_STATUS = "CASE c_custkey % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' WHEN 3 THEN 'unsupported' ELSE 'ready' END"


@query(f"""WITH p AS (SELECT o_custkey AS path, o_orderkey AS id, o_orderstatus AS hash FROM orders WHERE o_orderkey % 3 <> 0), c AS (SELECT o_custkey AS path, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 4 <> 0),
f AS (SELECT c_custkey AS path, {_STATUS} AS s, c_custkey IN (SELECT path FROM p) AS known FROM customer), t AS (SELECT path, CASE WHEN s = 'ready' AND known THEN 'full' WHEN s = 'partial' THEN 'added_only' WHEN s = 'failed' THEN 'extract_failed' WHEN s = 'unsupported' THEN 'extract_unsupported' ELSE 'cold_start' END AS tier FROM f)
SELECT path, id, CASE WHEN p.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'removed' ELSE 'changed' END AS change, tier FROM p FULL JOIN c USING (path, id) JOIN t USING (path) WHERE tier = 'full' AND p.hash IS DISTINCT FROM c.hash UNION ALL SELECT path, id, 'added', tier FROM c JOIN t USING (path) WHERE tier = 'added_only' UNION ALL SELECT path, NULL, 'changed', tier FROM t WHERE tier NOT IN ('full', 'added_only')""")
def file_diff_tiers(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("hash"))
    now = orders.where("id % 4 <> 0").withColumn("hash", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("hash")))
    status = F.get(F.array(*[F.lit(x) for x in ("ready", "partial", "failed", "unsupported", "ready")]), (F.col("c_custkey") % 5).cast("int"))
    return repairs.file_diff(orders.where("id % 3 <> 0"), now, read(spark, d, "customer").select(F.col("c_custkey").alias("path"), status.alias("status")))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'overlay_empty' WHEN p_size % 5 <> 0 AND p_partkey % 100 * 1000 < 60000 THEN 'idle_too_short' WHEN p_size % 11 = 1 THEN 'edit_tx_active' WHEN p_size % 11 = 2 THEN 'overlay_tx_active' WHEN p_size % 11 IN (3, 4) AND p_partkey * 1000 < 300000 THEN 'lsp_pending' WHEN p_size % 11 = 5 THEN 'rank_repairing' END AS block,
CASE WHEN p_size % 3 = 0 THEN 'local' WHEN p_partkey % 10 > 0 AND (p_size % 10) / (p_partkey % 10) >= 0.25 AND p_partkey * 100 >= 60000 THEN 'all' ELSE 'none' END AS ranks, CASE WHEN p_size % 4 = 0 THEN 'nothing' WHEN p_size % 4 = p_partkey % 4 THEN 'current' ELSE 'rebuild' END AS index FROM part""")
def upkeep_decisions(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    on = lambda *k: (size % 11).isin(*k).cast("int")
    block = repairs.compaction_block((size % 7), F.when(size % 5 != 0, key % 100 * 1000), on(1), on(2), on(3, 4), key * 1000, on(5) == 1)
    step = repairs.rank_step(F.when(size % 3 == 0, 2000), key * 100, size % 10, key % 10)
    return read(spark, d, "part").select("p_partkey", block.alias("block"), step.alias("ranks"), repairs.index_state(F.nullif((key % 4).cast("int"), F.lit(0)), size % 4).alias("index"))


@query("SELECT o_orderpriority AS lane, o_orderdate AS at, o_orderkey AS item FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 500")
def lane_queue(spark, d):
    own = read(spark, d, "orders").select(F.col("o_orderpriority").alias("lane"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("item"))
    return repairs.in_lanes(own, ["1-URGENT", "2-HIGH"], 500)


@query(f"WITH o AS ({OVERLAY}), s AS (SELECT snapshot_id, status FROM ({_MANIFEST})) SELECT (SELECT max(snapshot_id) FROM s WHERE status = 'committed') AS snapshot_id, (SELECT count(*) FROM s) AS snapshots, (SELECT count(*) FROM s WHERE status = 'pending') AS pending, (SELECT count(*) FROM orders) AS scores, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS stale, (SELECT count(*) FROM o) AS overlay_rows, (SELECT max(write_epoch) FROM o) AS newest_epoch, 'overlay_active' AS freshness")
def engine_status(spark, d):
    scores = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "stale").otherwise("exact").alias("status"))
    return api.status(_manifest(spark, d), scores, overlay(spark, d))


@query("WITH p AS (SELECT p_brand AS path, row_number() OVER (ORDER BY sum(p_retailprice) DESC, p_brand) AS place FROM part GROUP BY 1 QUALIFY place <= 5) SELECT path, place::INT AS place, any_value(path) || chr(10) || string_agg('  ' || p_size || ': ' || p_name || p_partkey, chr(10) ORDER BY p_size, p_name || p_partkey) AS text FROM p JOIN part ON p_brand = path GROUP BY path, place")
def rendered_map(spark, d):
    from factloom.operators.retrieval import ranks

    part = read(spark, d, "part")
    ranked = part.groupBy(F.col("p_brand").alias("id")).agg(F.sum("p_retailprice").alias("score"))
    placed = ranks(ranked).where("rank <= 5").select(F.col("id").alias("path"), F.col("rank").alias("place"))
    return api.rendered_map(placed, part.select(F.col("p_brand").alias("path"), F.col("p_size").alias("line"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name")))


_LATEST = "SELECT c_nationkey AS name, c_custkey % 9 AS graph_version, c_custkey AS node FROM customer"


@query(f"WITH s AS ({_LATEST}) SELECT name, graph_version, node, 'stale' AS status FROM s WHERE (name, graph_version) IN (SELECT (name, max(graph_version)) FROM s WHERE graph_version <= 6 GROUP BY name)")
def fallback_version(spark, d):
    own = read(spark, d, "customer").select(F.col("c_nationkey").alias("name"), (F.col("c_custkey") % 9).alias("graph_version"), F.col("c_custkey").alias("node"))
    return sinks.marked_stale(sinks.latest_version_at_most(own, "name", 6))


@query("SELECT p_partkey AS path, p_size AS modified FROM part WHERE p_partkey % 3 <> 0 OR p_size % 2 = 0")
def cache_misses(spark, d):
    own = read(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("modified"))
    return sinks.cache_misses(own, own.where("path % 3 = 0").withColumn("modified", F.when(F.col("modified") % 2 == 0, -1).otherwise(F.col("modified"))))


@query("SELECT r_regionkey AS file, r_name AS name, r_name AS qualified, 0 AS level FROM region UNION ALL SELECT n_regionkey, n_name, r_name || '.' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_regionkey, c_name, r_name || '.' || n_name || '.' || c_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def flattened_symbols(spark, d):
    nation = read(spark, d, "nation")
    roots = read(spark, d, "region").select(F.col("r_regionkey").alias("file"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    inner = nation.select("n_regionkey", F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), "n_name")
    leaves = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("n"), F.col("n_nationkey")), "c_name")
    return sinks.flattened_symbols(roots.union(inner).union(leaves), 3)


@query("WITH n AS (SELECT c_custkey, c_name, c_mktsegment FROM customer) SELECT c_name AS name, CASE WHEN c_custkey % 5 = 1 THEN 'saved' ELSE c_mktsegment END AS content FROM n WHERE c_custkey % 5 NOT IN (2, 3) UNION ALL SELECT 'moved/' || c_name, c_mktsegment FROM n WHERE c_custkey % 5 = 3")
def note_edits(spark, d):
    notes = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("content"), "c_custkey")
    ops = F.get(F.array(F.lit(None).cast("string"), F.lit("save"), F.lit("delete"), F.lit("rename"), F.lit(None).cast("string")), (F.col("c_custkey") % 5).cast("int"))
    edits = notes.select("name", F.lit(1).alias("ordinal"), ops.alias("op"), F.when(F.col("c_custkey") % 5 == 1, "saved").alias("content"), F.concat(F.lit("moved/"), "name").alias("new_name")).where("op is not null")
    earlier = edits.withColumn("ordinal", F.lit(0)).withColumn("op", F.lit("delete"))
    return sinks.notes_after(notes.select("name", "content"), edits.union(earlier))


@query("WITH h AS (SELECT page_id AS path, (length(html) - length(replace(html, '<p>', ''))) / 3 AS count, replace(html, '<p>', '<par>') AS text FROM pages) SELECT path, text, count::INT AS count FROM h WHERE count > 0")
def replaced_text(spark, d):
    own = read(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    return files.replaced(own, "<p>", "<par>").select("path", "text", "count")


@query("WITH d AS (SELECT doc_id AS path, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) SELECT path, array_to_string(l[2:4], chr(10)) AS text FROM d")
def line_range(spark, d):
    own = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return files.read_lines(own, 2, 4)


@query(f"WITH p AS ({_PATHS}) SELECT path FROM p WHERE regexp_matches(path, '^(.*/)?[^/]*2[^/]*/[^/]*$') ORDER BY path LIMIT 1000")
def glob_find(spark, d):
    return files.find(_paths(spark, d), "**/*2*/*")


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'cpp' WHEN 4 THEN 'unknown' ELSE 'zig' END AS language, CASE p_size % 6 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' ELSE 'other' END AS label FROM part")
def languages(spark, d):
    name = F.concat(F.lit("src/a.b/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.get(F.array(*[F.lit(x) for x in (".go", ".PY", ".tsx", ".cc", "", ".zig")]), F.col("p_size") % 6))
    return read(spark, d, "part").select("p_partkey", scalars.language_of(name).alias("language"), policy.language_label(name).alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'timeout' ELSE 'other' END END AS pending, CASE WHEN p_size % 5 = 0 THEN 'fallback' WHEN p_size % 7 = 0 THEN 'fallback' WHEN p_size % 11 = 0 THEN 'fallback' ELSE 'semantic' END AS source, CASE WHEN p_size % 5 = 0 THEN 'index_unavailable' WHEN p_size % 7 = 0 THEN 'not_covered' WHEN p_size % 11 = 0 THEN 'stale' END AS reason,
CASE WHEN p_size % 13 = 0 THEN 'missing' WHEN p_size % 2 = 0 THEN 'approximate' WHEN p_partkey % 3 < 2 THEN 'stale' ELSE 'exact' END AS status, least(greatest(p_retailprice / 1000 - 0.5, 0), 1)::DOUBLE AS clamped, (8 + length(p_name) // 4 + length(p_brand) // 4 + length(p_type) // 4)::BIGINT AS cost, length(p_brand) > 20 AS renames FROM part""")
def item_states(spark, d):
    size, chosen = F.col("p_size"), policy.chosen_source(F.col("p_size") % 5 != 0, F.col("p_size") % 11 != 0, F.col("p_size") % 7 != 0)
    pending = policy.pending_reason(F.when(size % 3 == 0, "pending").otherwise("ready"), F.when(size % 2 == 0, "timeout").otherwise("strange"), ["timeout", "queue_full"])
    status = scalars.score_status(size % 13 != 0, F.col("p_partkey") % 3, F.lit(2), size % 2 != 0)
    cost = scalars.candidate_cost("p_name", F.array("p_brand", "p_type")).cast("long")
    renames = policy.renames_by_text("p_brand", F.array("p_brand"))
    return read(spark, d, "part").select("p_partkey", pending.alias("pending"), chosen["source"].alias("source"), chosen["fallback_reason"].alias("reason"), status.alias("status"), scalars.clamp(F.col("p_retailprice") / 1000 - 0.5).alias("clamped"), cost.alias("cost"), renames.alias("renames"))


@query(f"WITH g AS (SELECT id, 'remove' AS action FROM ({_GONE}) UNION ALL SELECT c_custkey, 'upsert' FROM customer WHERE c_acctbal > 9000), n AS (SELECT dst AS id FROM ({LINKS}) WHERE src IN (SELECT id FROM g) UNION SELECT src FROM ({LINKS}) WHERE dst IN (SELECT id FROM g)) SELECT id, action FROM g UNION ALL SELECT id, 'dirty' FROM n WHERE id NOT IN (SELECT id FROM g)")
def repair_sets(spark, d):
    diff = read(spark, d, "customer").where("c_acctbal < 0 or c_acctbal > 9000").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "removed").otherwise("changed").alias("change"))
    return versioned.repair_sets(diff, links(spark, d))


@query(f"SELECT o_orderkey, write_epoch FROM ({OVERLAY}) WHERE write_epoch > 1500")
def cleared_overlay(spark, d):
    return versioned.cleared(overlay(spark, d), 1500).select("o_orderkey", "write_epoch")
