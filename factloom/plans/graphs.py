"""Queries on graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph, labels
from factloom.operators.components import dense_components, node_components

from .adapters import LINKS, TRADE, WEIGHTED, links, nations, read, trade, weighted
from .registry import query
from .scratch import written

ROUNDS = 5


def _pagerank_sql(teleport: str) -> str:
    steps = [f"w AS ({WEIGHTED})", "n AS (SELECT n_nationkey::BIGINT AS id FROM nation)", "o AS (SELECT src, sum(weight) AS total FROM w GROUP BY 1)", f"t AS ({teleport})", "r0 AS (SELECT id, t AS rank FROM t)"]
    for k in range(1, ROUNDS + 1):
        steps.append(f"f{k} AS (SELECT dst, sum(rank * weight / total) AS flow FROM r{k - 1} JOIN w ON id = src JOIN o USING (src) GROUP BY 1)")
        steps.append(f"l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE id NOT IN (SELECT src FROM o))")
        steps.append(f"r{k} AS (SELECT t.id, 0.15 * t + 0.85 * lost / (SELECT count(*) FROM n) + 0.85 * coalesce(flow, 0) AS rank FROM t LEFT JOIN f{k} ON t.id = dst, l{k})")
    return f"WITH {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{ROUNDS}"


@query(_pagerank_sql("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS t FROM n"))
def pagerank_fixed(spark, d):
    return graph.pagerank(nations(spark, d).select("id"), weighted(spark, d), ROUNDS, tolerance=None, cut=written).select("id", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql("SELECT id, w / sum(w) OVER () AS t FROM (SELECT id, CASE id WHEN 3 THEN 1.0 WHEN 7 THEN 0.8 ELSE 0.01 / (SELECT count(*) FROM n) END::DOUBLE AS w FROM n)"))
def personalized_pagerank_fixed(spark, d):
    seeds = spark.range(2).select(F.when(F.col("id") == 0, 3).otherwise(7).cast("long").alias("id"), F.when(F.col("id") == 0, 1.0).otherwise(0.8).alias("weight"))
    return graph.pagerank(nations(spark, d).select("id"), weighted(spark, d), ROUNDS, seeds, tolerance=None, cut=written).select("id", F.round("rank", 9).alias("rank"))


@query(f"SELECT src, dst, kind, n, round(sqrt(n), 9) AS weight FROM ({TRADE})")
def nation_trade_graph(spark, d):
    return trade(spark, d).select("src", "dst", "kind", "n", F.round(F.sqrt("n"), 9).alias("weight"))


#: Parts point to the parts of twice and three times their key; some of these are no parts, and some parts have no edge.
_PARTS = "SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 3 FROM part"


def _parts(spark, d):
    nodes = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return nodes, nodes.select(F.col("id").alias("src"), (F.col("id") * 2).alias("dst")).union(nodes.select("id", F.col("id") * 3))


_COMPONENTS = f"WITH RECURSIVE e AS (SELECT src, dst FROM ({_PARTS}) WHERE dst IN (SELECT p_partkey FROM part)), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(node, c) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, b.dst FROM r JOIN b ON r.c = b.src) SELECT node, min(c) AS component FROM r GROUP BY 1"


@query(_COMPONENTS)
def weak_components(spark, d):
    return node_components(*_parts(spark, d), written)


@query(f"SELECT component, count(*) AS size FROM ({_COMPONENTS}) GROUP BY 1 ORDER BY size DESC, component LIMIT 20")
def component_sizes_topn(spark, d):
    return node_components(*_parts(spark, d), written).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(20)


def _labels_sql(rounds: int) -> str:
    steps = [f"e AS (SELECT src, dst, 1.0 + src % 3 AS weight FROM ({_PARTS}) WHERE dst IN (SELECT p_partkey FROM part))", "b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)", "l0 AS (SELECT p_partkey AS id, p_partkey AS label FROM part)"]
    for k in range(1, rounds + 1):
        steps.append(f"v{k} AS (SELECT src, label, sum(weight) AS w FROM b JOIN l{k - 1} ON dst = id GROUP BY 1, 2)")
        steps.append(f"l{k} AS (SELECT id, coalesce(new, label) AS label FROM l{k - 1} LEFT JOIN (SELECT src, label AS new FROM v{k} QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, label) = 1) ON id = src)")
    return f"WITH {', '.join(steps)} SELECT id, label FROM l{rounds}"


@query(_labels_sql(4))
def label_rounds(spark, d):
    nodes, edges = _parts(spark, d)
    inner = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", (F.lit(1.0) + F.col("src") % 3).alias("weight"))
    return graph.propagate_labels(inner, nodes, 4, written)


@query(f"""WITH e AS ({TRADE}), m AS (SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS cluster FROM nation), s AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1),
c AS (SELECT a.cluster, count_if(a.cluster = b.cluster) AS intra, count_if(a.cluster IS DISTINCT FROM b.cluster) AS leaving FROM e JOIN m a ON src = a.id LEFT JOIN m b ON dst = b.id WHERE n > 3 GROUP BY 1)
SELECT cluster, size, coalesce(intra, 0)::BIGINT AS intra, coalesce(leaving, 0)::BIGINT AS leaving, round(CASE WHEN size > 1 THEN coalesce(intra, 0) / (size * (size - 1)) ELSE 0 END, 9) AS cohesion, round(CASE WHEN 2 * coalesce(intra, 0) + coalesce(leaving, 0) > 0 THEN leaving / (2 * intra + leaving) ELSE 0 END, 9) AS separation FROM s LEFT JOIN c USING (cluster)""")
def cohesion_separation(spark, d):
    out = graph.cluster_metrics(trade(spark, d).where("n > 3"), nations(spark, d))
    return out.select("cluster", "size", "intra", "leaving", F.round("cohesion", 9).alias("cohesion"), F.round("separation", 9).alias("separation"))


@query(f"SELECT cluster, kind, n FROM (SELECT n_regionkey::BIGINT AS cluster, kind, count(*) AS n FROM ({TRADE}) JOIN nation ON src = n_nationkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, kind) <= 2")
def dominant_edge_kinds(spark, d):
    return graph.dominant_kinds(trade(spark, d), nations(spark, d), 2).select("cluster", "kind", "n")


@query(f"WITH e AS ({LINKS}), a AS (SELECT 1::BIGINT AS id, 0 AS depth, NULL::BIGINT AS parent), b AS (SELECT dst AS id, 1 AS depth, min(src) AS parent FROM a JOIN e ON id = src WHERE dst <> 1 GROUP BY 1), c AS (SELECT dst AS id, 2 AS depth, min(src) AS parent FROM b JOIN e ON id = src WHERE dst NOT IN (SELECT id FROM a UNION SELECT id FROM b) GROUP BY 1) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def bfs_expand(spark, d):
    return graph.expand(links(spark, d), spark.range(1, 2), 2)


@query(f"WITH e AS ({LINKS}), s AS (SELECT c_custkey AS id FROM customer WHERE c_custkey BETWEEN 10 AND 14) SELECT id FROM s UNION SELECT dst FROM e WHERE src IN (SELECT id FROM s) UNION SELECT src FROM e WHERE dst IN (SELECT id FROM s)")
def frontier_one_hop(spark, d):
    return graph.one_hop(links(spark, d), read(spark, d, "customer").select(F.col("c_custkey").alias("id")).where("id between 10 and 14"))


@query(f"SELECT dst, src, a.c_name AS src_name, b.c_name AS dst_name FROM ({LINKS}) JOIN customer a ON src = a.c_custkey JOIN customer b ON dst = b.c_custkey WHERE dst = 42")
def callers_of(spark, d):
    names = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return graph.neighbours(links(spark, d).where("dst = 42"), names).select("dst", "src", "src_name", "dst_name")


_TREE = "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"


@query(f"WITH t AS ({_TREE}), a AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth FROM region), b AS (SELECT root, child AS id, 1 AS depth FROM a JOIN t ON id = parent), c AS (SELECT root, child AS id, 2 AS depth FROM b JOIN t ON id = parent), e AS (SELECT root, child AS id, 3 AS depth FROM c JOIN t ON id = parent) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e")
def hierarchy_depth3(spark, d):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    tree = read(spark, d, "nation").select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"))
    tree = tree.union(read(spark, d, "customer").select(key("n", "c_nationkey"), key("c", "c_custkey"))).union(read(spark, d, "orders").select(key("c", "o_custkey"), key("o", "o_orderkey")))
    return graph.descend(tree, read(spark, d, "region").select(key("r", "r_regionkey").alias("id")), 3)


_TAGS = "SELECT p_partkey % 200 AS file, p_type AS name FROM part"
_REFS = "SELECT l_suppkey + 1000000 AS file, p_type AS name FROM lineitem JOIN part ON l_partkey = p_partkey"


def _tags(spark, d):
    part = read(spark, d, "part")
    definitions = part.select((F.col("p_partkey") % 200).alias("file"), F.col("p_type").alias("name"))
    items = read(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    return definitions, items.join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_suppkey") + 1_000_000).alias("file"), F.col("p_type").alias("name"))


@query(f"WITH d AS ({_TAGS}), r AS ({_REFS}), g AS (SELECT name, count(*) AS degree FROM d GROUP BY 1), c AS (SELECT name, file, count(*) AS n FROM r GROUP BY ALL), w AS (SELECT c.file AS src, d.file AS dst, sqrt(n) / sqrt(1.0 + degree) AS weight FROM c JOIN d USING (name) JOIN g USING (name) WHERE c.file <> d.file UNION ALL SELECT file, file, 0.1 FROM d WHERE name NOT IN (SELECT name FROM r)) SELECT src, dst, round(sum(weight), 6) AS weight FROM w GROUP BY ALL")
def def_ref_file_graph(spark, d):
    definitions, references = _tags(spark, d)
    return graph.reference_graph(definitions, references).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("WITH d AS (SELECT p_partkey % 200 AS file, p_partkey * 3 AS name FROM part), r AS (SELECT l_partkey AS name FROM lineitem) SELECT file AS src, file AS dst, round(sum(0.1), 6) AS weight FROM d WHERE name NOT IN (SELECT name FROM r) GROUP BY ALL")
def isolated_defs_self_loops(spark, d):
    definitions = read(spark, d, "part").select((F.col("p_partkey") % 200).alias("file"), (F.col("p_partkey") * 3).alias("name"))
    references = read(spark, d, "lineitem").select(F.lit(-1).cast("long").alias("file"), F.col("l_partkey").alias("name"))
    out = graph.reference_graph(definitions, references)
    return out.where("src = dst").select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"SELECT src, dst, weight FROM (SELECT src, dst, round(weight, 9) AS weight FROM ({WEIGHTED})) QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 5")
def top_edges(spark, d):
    return graph.top_edges(weighted(spark, d).select("src", "dst", F.round("weight", 9).alias("weight")), 5)


@query(f"SELECT * FROM ({_pagerank_sql('SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS t FROM n')}) ORDER BY rank DESC, id LIMIT 10")
def ranked_nodes(spark, d):
    return graph.ranked_nodes(pagerank_fixed(spark, d), 10)


@query(f"SELECT src, dst, round(sum(weight), 6) AS weight FROM (SELECT src, dst, weight FROM ({WEIGHTED}) UNION ALL SELECT c_nationkey::BIGINT, c_custkey % 25, 1.0 FROM customer WHERE c_nationkey <> c_custkey % 25) GROUP BY ALL")
def enriched_graph(spark, d):
    found = read(spark, d, "customer").select((F.col("c_custkey") % 25).alias("file"), F.col("c_nationkey").cast("long").alias("target"))
    return graph.enriched(weighted(spark, d), found).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"SELECT src AS node, dst AS neighbour, TRUE AS outgoing, round(weight, 9) AS weight FROM ({WEIGHTED}) UNION ALL SELECT dst, src, FALSE, round(weight, 9) FROM ({WEIGHTED})")
def effective_adjacency(spark, d):
    return graph.adjacency(weighted(spark, d).select("src", "dst", F.round("weight", 9).alias("weight")))


_PLAN = "SELECT n_regionkey AS plan, n_nationkey AS id, CASE WHEN n_nationkey % 4 = 3 THEN [n_nationkey - 5, n_nationkey + 5] WHEN n_nationkey >= 10 THEN [n_nationkey - 10, 99] ELSE [] END AS requires FROM nation"


def _plan(spark, d):
    key = F.col("n_nationkey").cast("int")
    needs = F.when(key % 4 == 3, F.array(key - 5, key + 5)).when(key >= 10, F.array(key - 10, F.lit(99))).otherwise(F.array().cast("array<int>"))
    return read(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("plan"), key.alias("id"), needs.alias("requires"))


@query(f"""WITH RECURSIVE p AS (SELECT plan, id::INT AS id, requires FROM ({_PLAN})), n AS (SELECT p.plan, p.id, need::INT AS need FROM p, unnest(p.requires) AS u(need) JOIN p q ON q.plan = p.plan AND q.id = u.need),
k(plan, id, place, done) AS (SELECT plan, min(id), 1, [min(id)] FROM p WHERE id NOT IN (SELECT id FROM n) GROUP BY plan UNION ALL SELECT k.plan, min(p.id), k.place + 1, list_append(k.done, min(p.id)) FROM k JOIN p ON p.plan = k.plan LEFT JOIN (SELECT id, list(need) AS needs FROM n GROUP BY 1) w ON w.id = p.id WHERE NOT list_contains(k.done, p.id) AND (w.needs IS NULL OR list_has_all(k.done, w.needs)) GROUP BY k.plan, k.place, k.done)
SELECT plan::INT AS plan, id, place FROM k""")
def topological_order(spark, d):
    return graph.topological_order(_plan(spark, d), "plan")


@query(f"""WITH RECURSIVE p AS (SELECT id::INT AS id, requires FROM ({_PLAN}) UNION ALL SELECT 7, []), e AS (SELECT id, unnest(requires)::INT AS need FROM p), m AS (SELECT DISTINCT need AS id FROM e WHERE need NOT IN (SELECT id FROM p)), i AS (SELECT DISTINCT id, need FROM e WHERE need IN (SELECT id FROM p)),
r(id, c) AS (SELECT id, need FROM i UNION SELECT r.id, i.need FROM r JOIN i ON r.c = i.id), c AS (SELECT DISTINCT id FROM r WHERE id = c)
SELECT id, 'duplicate' AS fault FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'missing' FROM m UNION ALL SELECT DISTINCT id, 'cycle' FROM (SELECT id FROM c UNION SELECT id FROM r WHERE c IN (SELECT id FROM c))""")
def phase_faults(spark, d):
    own = _plan(spark, d).select("id", "requires")
    again = spark.range(1).select(F.lit(7).alias("id"), F.array().cast("array<int>").alias("requires"))
    return graph.phase_faults(own.union(again), written)


def _supplies(spark, d):
    """All edges from suppliers to the parts that they sold."""
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.lit(1_000_000_000) + F.col("l_partkey")).alias("dst")).distinct()


# Without SQL: reachability over the whole table is too slow for it. Tests hold these against brute force.


@query()
def weak_components_whole(spark, d):
    return dense_components(_supplies(spark, d), written)


@query()
def component_sizes_topn_whole(spark, d):
    return dense_components(_supplies(spark, d), written).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(20)


@query()
def label_propagation(spark, d):
    """Clusters of suppliers and parts: components, the large ones split by labels."""
    edges = _supplies(spark, d).withColumn("weight", F.lit(1.0))
    return labels.split_components(None, edges, written)


_SUPPLIES = "SELECT DISTINCT l_suppkey AS src, 1000000000 + l_partkey AS dst FROM lineitem"


def _supply_ranks_sql(rounds: int) -> str:
    steps = [f"s AS MATERIALIZED ({_SUPPLIES})", "w AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS total FROM (SELECT src, dst FROM s UNION ALL SELECT dst, src FROM s))", "r0 AS MATERIALIZED (SELECT src AS id, 1.0::DOUBLE / (SELECT count(DISTINCT src) FROM w) AS t, 1.0::DOUBLE / (SELECT count(DISTINCT src) FROM w) AS rank FROM w GROUP BY 1)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT id, t, 0.15 * t + 0.85 * coalesce(flow, 0) AS rank FROM r{k - 1} LEFT JOIN (SELECT dst, sum(rank / total) AS flow FROM r{k - 1} JOIN w ON id = src GROUP BY 1) ON id = dst)")
    return f"WITH {', '.join(steps)} SELECT id, round(rank, 10) AS rank FROM r{rounds}"


@query(_supply_ranks_sql(ROUNDS))
def pagerank_supplies(spark, d):
    """Ranks of all suppliers and parts, over every pair of them in lineitem both ways."""
    edges = written(_supplies(spark, d), "supplies")
    both = edges.union(edges.select("dst", "src")).withColumn("weight", F.lit(1.0))
    found = graph.pagerank(graph.nodes_of(edges), both, ROUNDS, tolerance=None, cut=written, inside=True)
    return found.select("id", F.round("rank", 10).alias("rank"))
