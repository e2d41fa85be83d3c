"""Weak components of large graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is hot; of a larger table, one with over the share, so that hot keys stay few enough to broadcast.
HOT_ROWS, HOT_SHARE = 2000, 100_000


def with_group_facts(rows: DataFrame, groups: DataFrame, key: str, total: int, most: int) -> DataFrame:
    """rows with what groups (key, ..., n) says of their key, n rows each, `total` in all and `most` at most. A hot key's rows stay where they are.

    There are at most total / hot hot keys, that is HOT_SHARE where the table is large, so their table has a bound of its
    own and is broadcast; all other keys have few rows and are joined by them.
    """
    hot, facts = max(HOT_ROWS, total // HOT_SHARE), groups.drop("n")
    if most <= hot:
        return rows.join(facts, key)
    hubs = groups.where(F.col("n") > hot).drop("n")
    cold = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(hubs), key).unionByName(cold)


def components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that edges (src, dst) reach, for every node on an edge.

    Alternates large-star and small-star steps until all edges lead to their least node, each round a few shuffles
    whose rows are at most the edges. A large star's centre is only ever pointed at, and its rows are
    pre-aggregated to the least neighbour, so that no task gathers a node's neighbours. `cut(df, name)`
    materialises a round, and within it what several plans read: nested in one another, the plans of hot keys
    were megabytes that the driver holds for each job.
    """
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    now = cut(now, "components")
    for _ in range(most_rounds + 1):
        both = now.union(now.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("edges"), F.count_if(F.col("b") > F.col("a")).alias("n")), "least")
        # unsettled: nodes that point to a smaller one and have other neighbours too
        moving = (F.col("m") < F.col("a")) & (F.col("edges") > 1)
        size, most, low, moves = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max(F.col("edges") - F.col("n")), F.lit(0)), F.coalesce(F.bool_or(moving), F.lit(False))).first()
        if not moves:
            break
        # large-star: every larger neighbour of a node points to the node's least neighbour or itself
        stars = with_group_facts(now.select(F.col("b").alias("a"), F.col("a").alias("b")), least.where("n > 0").select("a", F.least("a", "m").alias("m"), "n"), "a", size, most)
        large = cut(stars.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # small-star: every smaller neighbour of a node, and the node, point to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        now = with_group_facts(large, small, "a", size, low).select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut(now, "components")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())


def node_components(nodes: DataFrame, edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of nodes (id): isolated ones are their own component, edges that touch an unknown node do not count."""
    known = nodes.select("id").where("id is not null").distinct()
    inside = edges.select("src", "dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = components(inside, cut, most_rounds)
    return known.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


# Graphs of many more edges than nodes: stars run on two edges of each node, and all edges meet what came of it once.


def pairs_of(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(a, b, weight): neighbours a < b of nodes (id) once, by edges (src, dst, weight), and a loop for nodes that may have none. nodes None: all that edges name."""
    if nodes is not None:
        own = nodes.select("id").where("id is not null").distinct()
        inner = edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges = inner.select("src", "dst", "weight").union(own.select("id", "id", F.lit(0.0)))
    # least and greatest pass over nulls, so that an edge with one end is a loop
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").where("a is not null")
    return ends.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def ends_of(pairs: DataFrame) -> DataFrame:
    """(id, n, least, most) of all nodes on pairs (a, b): how many neighbours a node has, the smallest and the largest of them."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.where("a < b").select("b", "a"))
    return both.groupBy("id").agg(F.count_if(F.col("id") != F.col("other")).alias("n"), F.min("other").alias("least"), F.max("other").alias("most"))


def told(rows: DataFrame, facts: DataFrame, end: str, **names: str) -> DataFrame:
    """rows with facts (id, ...) about one end, named as asked. Facts are few beside rows, so that they are hashed and no rows are sorted."""
    return rows.join(facts.select(F.col("id").alias(end), *[F.col(k).alias(v) for k, v in names.items()]).hint("shuffle_hash"), end)


def sampled_components(ends: DataFrame, cut: Callable[[DataFrame, str], DataFrame], most_rounds: int = 60) -> DataFrame:
    """(id, n, component) of ends (id, n, least, most): components by each node's smallest and largest neighbour alone, parts of the whole ones."""
    found = components(ends.select(F.col("id").alias("src"), F.col("least").alias("dst")).union(ends.select("id", "most")), cut, most_rounds)
    return ends.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def rejoined(facts: DataFrame, across: DataFrame, cut: Callable[[DataFrame, str], DataFrame], most_rounds: int = 60) -> DataFrame:
    """facts (id, n, component) with those components made one that pairs (ca, cb) lead across."""
    across = cut(across.where("ca <> cb").select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct(), "across")
    if across.isEmpty():
        return facts
    whole = components(across, cut, most_rounds).select(F.col("node").alias("component"), F.col("component").alias("of"))
    return facts.join(whole, "component", "left").select("id", "n", F.coalesce("of", "component").alias("component"))


def dense_components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """components(edges), where edges are many more than nodes."""
    pairs = cut(pairs_of(None, edges.where("src <> dst").select("src", "dst", F.lit(1.0).alias("weight"))).select("a", "b"), "pairs")
    facts = cut(sampled_components(ends_of(pairs), cut), "facts")
    across = told(told(pairs.where("a < b"), facts, "a", component="ca"), facts, "b", component="cb")
    return rejoined(facts, across, cut).select(F.col("id").alias("node"), "component")
