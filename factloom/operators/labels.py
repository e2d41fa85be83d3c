"""Label propagation that settles: nodes of one colour are no neighbours, and colours take their turns.

If all nodes change at once, two neighbours may swap labels for ever. Here a node sees what the colours before its own have become, as if
nodes went one by one, by colour and id; a change never lowers the weight between equal labels, and a tie only ever lowers the label, so that
rounds come to rest.

A pair of neighbours is one row, an arc, from the end with fewer neighbours (low) to the one with more (high). All that is said of nodes meets
the arcs once for each end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import ends_of, pairs_of, rejoined, sampled_components, told

#: Components of more members are split, in so many rounds at most.
MOST_MEMBERS, ROUNDS = 5_000, 20

Cut = Callable[[DataFrame, str], DataFrame]


def _arc() -> list:
    """(low, high) of a pair (a, b) with their numbers of neighbours (na, nb): numbers of neighbours, then hashes, then ids decide."""
    rising = F.struct("na", F.xxhash64("a"), "a") < F.struct("nb", F.xxhash64("b"), "b")
    return [F.when(rising, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(rising, F.col("b")).otherwise(F.col("a")).alias("high")]


def _arcs(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    return told(told(pairs.where("a < b"), ends, "a", n="na"), ends, "b", n="nb").select(*_arc(), "weight")


def _colours(ends: DataFrame, arcs: DataFrame, cut: Cut) -> tuple[DataFrame, bool]:
    """(id, colour) of the nodes of arcs and of ends, and whether every low is of colour 1 and every high of colour 0.

    A node gets the least colour that none above it has, so colours are those of a greedy walk from hubs down. A node that is never low has
    colour 0. One that is never high decides nothing, and waits for the rest to be done; only those between take rounds.
    """
    sides = arcs.select(F.col("low").alias("id"), F.lit(1).alias("l"), F.lit(0).alias("h")).union(arcs.select("high", F.lit(0), F.lit(1)))
    sides = cut(sides.groupBy("id").agg(F.max("l").alias("l"), F.max("h").alias("h")), "sides")
    between = sides.where("l = 1 and h = 1").select("id")
    roots = ends.select("id").join(sides.where("l = 1").select("id"), "id", "left_anti").select("id", F.lit(0).alias("colour"))
    last = sides.where("l = 1 and h = 0").select("id")
    if between.isEmpty():
        return roots.union(last.select("id", F.lit(1).alias("colour"))), True

    def least_free(met: DataFrame) -> DataFrame:
        """(id, colour) of lows by the colours that they met (low, colour)."""
        used = met.groupBy("low").agg(F.collect_set("colour").alias("used"))
        return used.select(F.col("low").alias("id"), F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")).alias("colour"))

    def met(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of.withColumnRenamed("id", "high"), "high").select("low", "colour").distinct()

    open_ = arcs.select("low", "high").join(between.withColumnRenamed("id", "low"), "low", "left_semi")
    done = fresh = cut(roots, "coloured")
    seen = None
    while True:
        now = met(open_, fresh)
        seen = cut(now if seen is None else seen.union(now).distinct(), "seen")
        open_ = cut(open_.join(fresh.select(F.col("id").alias("high")), "high", "left_anti").select("low", "high"), "open")
        fresh = cut(least_free(seen.join(open_.select("low"), "low", "left_anti")), "fresh")
        if fresh.isEmpty():
            break
        done = cut(done.union(fresh), "coloured")
        seen = seen.join(fresh.select(F.col("id").alias("low")), "low", "left_anti")
    rest = arcs.select("low", "high").join(last.withColumnRenamed("id", "low"), "low", "left_semi")
    return done.union(least_free(met(rest, done))), False


def coloured(nodes: DataFrame, edges: DataFrame, cut: Cut) -> DataFrame:
    """(id, colour) of nodes (id) such that no edge (src, dst) joins two of a colour; colours count from 0.

    The least that no neighbour has, by degree from hubs down, then by a hash of the id. With hubs first there are few rounds and few colours:
    two where a graph has two sides of unlike degree. Hubs need no task of their own: of a node's neighbours above it there are never more than
    the root of twice all edges, and what is taken of the others is a count.
    """
    pairs = cut(pairs_of(nodes, edges.select("src", "dst", F.lit(1.0).alias("weight"))), "pairs")
    ends = cut(ends_of(pairs), "ends")
    return _colours(ends, cut(_arcs(pairs, ends), "arcs"), cut)[0]


def _settled(ends: DataFrame, arcs: DataFrame, cut: Cut, rounds: int) -> DataFrame:
    marks, two = _colours(ends, arcs, cut)
    marks = cut(marks, "colours")
    colours = sorted(r["colour"] for r in marks.select("colour").distinct().collect())
    if two:
        turn = {1: arcs.select(F.col("low").alias("src"), F.col("high").alias("dst"), "weight"), 0: arcs.select(F.col("high").alias("src"), F.col("low").alias("dst"), "weight")}
    else:
        both = arcs.select(F.col("low").alias("src"), F.col("high").alias("dst"), "weight").union(arcs.select("high", "low", "weight"))
        turns = cut(told(both, marks, "src", colour="colour").repartition("colour", F.pmod(F.xxhash64("dst"), F.lit(16))), "turns")
        turn = {c: turns.where(F.col("colour") == c) for c in colours}
    now = {c: marks.where(F.col("colour") == c).select("id", F.col("id").alias("label")) for c in colours}
    first, due = True, set(colours)
    for _ in range(rounds):
        for c in colours:
            if c not in due:  # nothing about these nodes has changed since their last turn
                continue
            if first:  # every node is its own label yet, and a pair is one vote
                votes = turn[c].select("src", F.col("dst").alias("label"), F.col("weight").alias("w"))
            else:
                labels = reduce(DataFrame.union, [now[k] for k in colours if k != c] or [now[c]])
                votes = told(turn[c], labels, "dst", label="label").groupBy("src", "label").agg(F.sum("weight").alias("w"))
            best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("new"))
            after = now[c].join(best, F.col("id") == F.col("src"), "left").select("id", F.coalesce("new", "label").alias("label"), F.col("label").alias("before"))
            after = cut(after, "labels")
            first = False
            due.discard(c)
            if not after.where("label <> before").isEmpty():
                due |= set(colours) - {c}
            now[c] = after.select("id", "label")
        if not due:
            break
    return reduce(DataFrame.union, now.values()) if now else ends.select("id", F.col("id").alias("label"))


def settled_labels(nodes: DataFrame, edges: DataFrame, cut: Cut, rounds: int = ROUNDS) -> DataFrame:
    """(id, label) of nodes (id): each takes the label of most weight (src, dst, weight) about it, the smallest at ties, until nothing changes."""
    pairs = cut(pairs_of(nodes, edges), "pairs")
    ends = cut(ends_of(pairs), "ends")
    return _settled(ends, cut(_arcs(pairs, ends), "arcs"), cut, rounds)


def split_components(nodes: DataFrame | None, edges: DataFrame, cut: Cut, most: int | None = None, rounds: int | None = None) -> DataFrame:
    """(id, component, label) of nodes (id): a component of up to `most` members is one cluster, named as it is; a larger one is split by labels.

    nodes None: all that edges name.
    """
    pairs = cut(pairs_of(nodes, edges), "pairs")
    facts = cut(sampled_components(cut(ends_of(pairs), "ends"), cut), "facts")
    both = told(told(pairs.where("a < b"), facts, "a", n="na", component="ca"), facts, "b", n="nb", component="cb")
    arcs = cut(both.select(*_arc(), "weight", "ca", "cb"), "arcs")
    found = cut(rejoined(facts, arcs, cut), "members")
    sizes = found.groupBy("component").agg((F.count("*") > (MOST_MEMBERS if most is None else most)).alias("large"))
    sizes = cut(sizes, "sizes")
    large = sizes.where("large")
    if large.isEmpty():
        return found.select("id", "component", F.col("component").alias("label"))
    inside = found
    if not sizes.where("not large").isEmpty():
        inside = cut(found.join(large, "component", "left_semi").select("id", "n"), "large")
        # an arc's ends are in one component
        arcs = cut(arcs.select("low", "high", "weight").join(inside.select(F.col("id").alias("low")).hint("shuffle_hash"), "low", "left_semi"), "arcs")
    labels = _settled(inside, arcs, cut, ROUNDS if rounds is None else rounds)
    return found.join(labels, "id", "left").select("id", "component", F.coalesce("label", "component").alias("label"))
