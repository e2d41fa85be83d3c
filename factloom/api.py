"""The engine's questions, each a composition of operators that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import clamp
from factloom.operators import graph, retrieval
from factloom.operators.resolve import CRITICAL, stored_kinds

#: Fixed limits of answers.
IMPACT_DEPTH, IMPACT_NODES, IMPACT_EDGES, IMPACT_CAP = 5, 200, 500, 0.6
LEAST_BUDGET, MOST_BUDGET, MOST_RELATED = 64, 32_768, 100


def allowed_path(path: Column, prefixes: list[str]) -> Column:
    """Whether a path begins with one of the prefixes; none allow all, and an empty path is never allowed by some."""
    if not prefixes:
        return F.lit(True)
    found = F.lit(False)
    for prefix in prefixes:
        found = found | path.startswith(prefix)
    return F.coalesce(found & (path != ""), F.lit(False))


def change_impact(edges: DataFrame, seeds: DataFrame, depth: int = 2, kinds: list[str] | None = None, cut=None, most_nodes: int = IMPACT_NODES, most_edges: int = IMPACT_EDGES) -> DataFrame:
    """(src, dst, kind, confidence, nodes, edges, truncated): the edges by which a change at the seeds spreads.

    Those who depend on the seeds are found against the edges' direction, each at its least depth. All edges
    keep their confidence unless one of the reached is unsure, which caps them all; totals are before the cut.
    """
    depth = max(1, min(depth, IMPACT_DEPTH))
    reached = graph.expand(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth, cut).where("depth > 0")
    own = edges.join(reached.select(F.col("id").alias("src"), F.col("parent").alias("dst"), "depth"), ["src", "dst"])
    shown = own.where(F.col("kind").isin(stored_kinds(kinds))) if kinds else own
    total = own.agg(F.countDistinct("src").alias("nodes"), F.coalesce(F.bool_or(F.col("confidence") < CRITICAL), F.lit(False)).alias("unsure"))
    counted = shown.agg(F.count("*").alias("edges"))
    # the nearest nodes first: a bounded top-k by partial sorts, not a window over everything
    nodes = reached.orderBy("depth", "id").limit(most_nodes).select(F.col("id").alias("src"))
    kept = shown.join(F.broadcast(nodes), "src", "left_semi").orderBy("depth", "src", "kind").limit(most_edges)
    out = kept.join(F.broadcast(total)).join(F.broadcast(counted))
    return out.select("src", "dst", "kind", F.when(F.col("unsure"), F.least("confidence", F.lit(IMPACT_CAP))).otherwise(F.col("confidence")).alias("confidence"), "nodes", "edges", ((F.col("nodes") > most_nodes) | (F.col("edges") > most_edges)).alias("truncated"))


def related(text: DataFrame, ranked: DataFrame, clusters: DataFrame, seed, paths: DataFrame, prefixes: list[str], k: int = 20) -> DataFrame:
    """(id, score, total): two ranked lists fused, raised within the seed's cluster, kept to allowed paths, the best k."""
    scored = retrieval.boosted(retrieval.fuse(text, ranked), clusters, seed).where(F.col("id") != F.lit(seed))
    held = scored.join(paths.select("id", "path"), "id", "left").where(allowed_path(F.coalesce("path", F.lit("")), prefixes))
    total = held.agg(F.count("*").alias("total"))
    return held.orderBy(F.desc("score"), "id").limit(max(1, min(k, MOST_RELATED))).join(F.broadcast(total)).select("id", "score", "total")


def semantic_context(index: DataFrame, terms: list[str], ranked: DataFrame, costs: DataFrame, budget: int = 2048, top: int = 256) -> DataFrame:
    """(id, score, cost, place): what a token budget holds of the best by text and rank together.

    `index` is what `retrieval.bm25` reads, postings or texts; `ranked` is (id, rank); a candidate over what is left of the budget is passed over.
    """
    budget = max(LEAST_BUDGET, min(budget, MOST_BUDGET))
    fused = retrieval.fuse(retrieval.ranks(retrieval.bm25(index, terms, top, 6)), ranked).select("id", F.round("score", 12).alias("score"))
    best = fused.orderBy(F.desc("score"), "id").limit(2 * top).join(costs.select("id", "cost"), "id")
    placed = best.select("id", "score", "cost", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("place"), F.lit(1).alias("one"))
    return placed.join(F.broadcast(retrieval.packed(placed, budget, "one", "place", "cost").select("place")), "place").select("id", F.col("score"), "cost", "place")


def repo_map(ranked: DataFrame, budget: int, tolerance: float = 0.15) -> DataFrame:
    """(path, place, used): the longest prefix of ranked files (path, score, cost) that a budget holds.

    The prefix may pass the budget by less than the tolerance and always has one file. Only candidates that a
    prefix within the budget can hold are sorted in one place: as each costs at least a token, these are bounded
    by the budget.
    """
    room = F.lit(budget * (1 + tolerance))
    head = ranked.where("cost > 0").orderBy(F.desc("score"), "path").limit(int(budget * (1 + tolerance)) + 1)
    order = Window.orderBy(F.desc("score"), "path")
    placed = head.select("path", F.row_number().over(order).alias("place"), F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return placed.where((F.col("used") < room) | (F.col("place") == 1))


def cluster_map(members: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """The largest clusters with their size, cohesion, separation and most frequent kind of edge."""
    kinds = graph.dominant_kinds(edges, members, 1).select("cluster", F.col("kind").alias("dominant_kind"))
    largest = members.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster").limit(max(1, min(top, 100))).select("cluster")
    return graph.cluster_metrics(edges, members.join(F.broadcast(largest), "cluster", "left_semi").select("id", "cluster")).join(kinds, "cluster", "left")


#: How many callers and edges an explanation shows.
SHOWN_CALLERS, SHOWN_EDGES = 50, 100


def explain(symbols: DataFrame, edges: DataFrame, clusters: DataFrame, seed, types: DataFrame | None = None, most_callers: int | None = SHOWN_CALLERS, most_edges: int | None = SHOWN_EDGES) -> DataFrame:
    """(aspect, id, detail): a symbol's callers, callees and cluster, and the steps of its type chain where types are given; one row each.

    `types` is (id, step, type): how the symbol's type was found, in order. Callers are the first by id, and so are callees; None: all of them.
    """
    first = lambda rows, most: rows.distinct() if most is None else rows.distinct().orderBy("id").limit(most)
    into = first(edges.where(F.col("dst") == seed).select(F.lit("caller").alias("aspect"), F.col("src").alias("id")), most_callers)
    out = first(edges.where(F.col("src") == seed).select(F.lit("callee").alias("aspect"), F.col("dst").alias("id")), most_edges)
    named = into.union(out).join(symbols.select("id", F.col("name").alias("detail")), "id").select("aspect", "id", "detail")
    own = clusters.where(F.col("id") == seed).select("cluster").join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    whole = named.union(own.select(F.lit("cluster"), F.col("cluster"), F.col("n").cast("string")))
    return whole if types is None else whole.union(types.where(F.col("id") == seed).select(F.lit("type"), F.col("step"), F.col("type")))


def rendered_map(placed: DataFrame, definitions: DataFrame) -> DataFrame:
    """(path, place, text) of placed files (path, place): the path and below it a line for each definition (path, line, name), in order of lines."""
    listed = definitions.join(placed.select("path"), "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "name"))).alias("x"))
    lines = F.transform("x", lambda d: F.concat(F.lit("  "), d["line"].cast("string"), F.lit(": "), d["name"]))
    return placed.join(listed, "path", "left").select("path", "place", F.concat_ws("\n", F.col("path").cast("string"), lines).alias("text"))


def status(snapshots: DataFrame, scores: DataFrame, overlay: DataFrame) -> DataFrame:
    """(snapshot_id, snapshots, pending, scores, stale, overlay_rows, newest_epoch, freshness): one row on the state of everything.

    Without a committed snapshot all is missing; then overlay rows make it overlay_active, stale scores stale, else it is fresh.
    """
    own = snapshots.agg(F.coalesce(F.max(F.when(F.col("status") == "committed", F.col("snapshot_id"))), F.lit(0).cast("long")).alias("snapshot_id"), F.count("*").alias("snapshots"), F.count_if(F.col("status") == "pending").alias("pending"))
    ranked = scores.agg(F.count("*").alias("scores"), F.count_if(F.col("status") == "stale").alias("stale"))
    live = overlay.agg(F.count("*").alias("overlay_rows"), F.coalesce(F.max("write_epoch"), F.lit(0).cast("long")).alias("newest_epoch"))
    row = own.join(F.broadcast(ranked)).join(F.broadcast(live))
    state = F.when(F.col("snapshot_id") == 0, "missing").when(F.col("overlay_rows") > 0, "overlay_active").when(F.col("stale") > 0, "stale").otherwise("fresh")
    return row.withColumn("freshness", state)


def blast_radius(edges: DataFrame, seeds: DataFrame, files: DataFrame, depth: int = 2, cut=None) -> DataFrame:
    """(symbols, files, directories): how many a change at the seeds can reach, seeds left out."""
    reached = graph.expand(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth, cut).where("depth > 0")
    held = reached.select("id").join(files.select("id", "path"), "id", "left")
    return held.agg(F.countDistinct("id").alias("symbols"), F.countDistinct("path").alias("files"), F.countDistinct(F.regexp_replace("path", "/?[^/]*$", "")).alias("directories"))


def local_ranks(nodes: DataFrame, edges: DataFrame, changed: DataFrame, most: int = 5000, rounds: int = 100, cut=None, tolerance: float | None = 1e-6) -> DataFrame | None:
    """(id, rank, status) of the changed nodes and their neighbours alone, or None where they are too many and all is stale.

    The scores are of the frontier's own scale, so they are marked approximate.
    """
    front = graph.one_hop(edges, changed)
    front = cut(front, "frontier") if cut else front
    if front.limit(most + 1).count() > most:
        return None
    inner = edges.join(F.broadcast(front.withColumnRenamed("id", "src")), "src", "left_semi").join(F.broadcast(front.withColumnRenamed("id", "dst")), "dst", "left_semi")
    own = nodes.join(F.broadcast(front), "id", "left_semi").select("id")
    return graph.pagerank(own, inner, rounds, tolerance=tolerance if cut else None, cut=cut).withColumn("status", F.lit("approximate"))


def recomputed(nodes: DataFrame, edges: DataFrame, version, cut, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank, status, graph_version): all ranks; approximate where the graph's version, read by `version()`, moved meanwhile."""
    before = version()
    ranks = cut(graph.pagerank(nodes, edges, rounds, tolerance=tolerance, cut=cut), "ranks")
    return ranks.select("id", "rank", F.lit("exact" if version() == before else "approximate").alias("status"), F.lit(before).cast("long").alias("graph_version"))


def evidence_for(edges: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Confidence of edges within bounds, beside what they were."""
    return edges.withColumn("bounded", clamp("confidence", low, high))
