"""Graphs as edge tables: ranking, neighbourhoods, clusters, hierarchies.

Iterative operators take `cut(df, name)`, which materialises a round and so cuts its lineage; without it
the plan grows by a round at a time, which a few fixed rounds bear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import with_group_facts

DAMPING, BASELINE = 0.85, 0.01


def accumulated(edges: DataFrame, weight: str = "weight") -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum(weight).alias("weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


#: Definitions (name, file) up to this number are broadcast, as a table of some ten MB; more of them are joined by name.
MOST_BROADCAST = 200_000


def reference_graph(definitions: DataFrame, references: DataFrame, loop_weight: float = 0.1, most_broadcast: int | None = None) -> DataFrame:
    """File graph from definitions (name, file) and references (name, file), a row for each occurrence.

    An edge goes from the referring to the defining file and weighs sqrt(references) / sqrt(1 + definitions
    of the name), for each definition; a definition that nothing refers to gives its file a small loop.
    Definitions of a name in one file are counted before they meet references, so that these meet files only.
    """
    most = MOST_BROADCAST if most_broadcast is None else most_broadcast
    held = definitions.groupBy("name", "file").agg(F.count("*").alias("held"))
    degree = held.groupBy("name").agg(F.sum("held").alias("degree"))
    share = held.join(degree, "name").select("name", F.col("file").alias("dst"), (F.col("held") / F.sqrt(F.lit(1.0) + F.col("degree"))).alias("share"))
    counted = references.groupBy("name", "file").agg(F.count("*").alias("n")).withColumnRenamed("file", "src")
    if held.limit(most + 1).count() <= most:
        # a referring file's rows lie together, so that its edges add up where they are made
        counted, share = counted.repartition("src"), F.broadcast(share)
    weighed = counted.join(share, "name").where("src <> dst").groupBy("src", "dst").agg(F.sum(F.sqrt("n") * F.col("share")).alias("weight"))
    alone = held.join(references.select("name").distinct(), "name", "left_anti")
    loops = alone.groupBy("file").agg((F.sum("held") * F.lit(loop_weight)).alias("weight")).select(F.col("file").alias("src"), F.col("file").alias("dst"), "weight")
    return weighed.union(loops)  # no edge of the first kind is a loop


def teleport(nodes: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(id, t): uniform, or by seed weights (id, weight) over a baseline of 0.01 spread evenly; sums to 1."""
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    base = nodes.join(F.broadcast(n))
    if seeds is None:
        return base.select("id", (1 / F.col("n")).alias("t"))
    held = base.join(seeds.where("weight > 0").select("id", "weight"), "id", "left").select("id", F.coalesce("weight", F.lit(BASELINE) / F.col("n")).alias("w"))
    return held.join(F.broadcast(held.agg(F.sum("w").alias("total")))).select("id", (F.col("w") / F.col("total")).alias("t"))


#: Moves of a node with many targets are dealt to blocks of about so many moves, if there are so many targets for each block.
BLOCK_MOVES, LEAST_BLOCKS, LEAST_SHARE = 20_000_000, 16, 8


def fanned(edges: DataFrame, out: DataFrame, cut, block_moves: int | None = None) -> DataFrame:
    """(src, p, block, dsts): edges (src, dst, weight) with out (src, out, n), a row for all targets that get the same part p of a node's rank.

    A node with more than LEAST_SHARE targets for each block has a row for each block of its targets, so that its rank goes to a block once;
    others have block null. Blocks grow in number with the edges.
    """
    out = cut(out, "out")
    total, most = out.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, total // (BLOCK_MOVES if block_moves is None else block_moves))
    led = with_group_facts(edges.select("src", "dst", "weight"), out.withColumn("fan", F.col("n")), "src", total, most)
    block = F.when(F.col("fan") > LEAST_SHARE * blocks, F.pmod(F.xxhash64("dst"), F.lit(blocks)).cast("int"))
    rows = led.select("src", "dst", (F.col("weight") / F.col("out")).alias("p"), block.alias("block"))
    return cut(rows.groupBy("src", "p", "block").agg(F.collect_list("dst").alias("dsts")), "moves")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, seeds: DataFrame | None = None, tolerance: float | None = 1e-6, cut=None, damping: float = DAMPING, inside: bool = False) -> DataFrame:
    """(id, rank) by power iteration; the mass of nodes without outgoing weight is spread evenly.

    With a tolerance, it stops where the ranks' total change falls below it; without one, all rounds run and
    no action is needed but for a cut. `inside` says that edges have no ends but nodes, or null.

    With a cut, what is dealt in a round are rows of many targets, and parts of ranks are added up where a block's targets lie together, before
    they are dealt: a small part of a row for each edge and round.
    """
    kept = edges.where("weight > 0 and src is not null and dst is not null")
    if not inside:
        kept = kept.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = kept.groupBy("src").agg(F.sum("weight").alias("out"), F.count("*").alias("n"))
    base = teleport(nodes, seeds).join(out.select(F.col("src").alias("id"), F.lit(True).alias("has_out")), "id", "left").select("id", "t", F.col("has_out").isNull().alias("dangling"))
    if cut:
        moves, base = fanned(kept, out, cut), cut(base, "base")
        far = not moves.where("block is not null").isEmpty()
    else:
        moves = kept.join(out, "src").select("src", (F.col("weight") / F.col("out")).alias("p"), F.array("dst").alias("dsts"))
        far = False
    rank = base.withColumn("rank", F.col("t"))
    for _ in range(rounds):
        held = rank.select(F.col("id").alias("src"), "rank")
        led = moves.join(held.hint("shuffle_hash") if cut else held, "src").withColumn("part", F.col("rank") * F.col("p"))
        if far:
            led = led.where("block is null").select("part", "dsts").union(led.where("block is not null").select("block", "part", "dsts").repartition("block").select("part", "dsts"))
        flow = led.select(F.explode("dsts").alias("dst"), "part").groupBy("dst").agg(F.sum("part").alias("flow"))
        totals = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"), F.count("*").alias("n"))
        next_ = rank.withColumnRenamed("rank", "before").join(flow, F.col("id") == F.col("dst"), "left").join(F.broadcast(totals))
        next_ = next_.select("id", "t", "dangling", "before", ((1 - damping) * F.col("t") + damping * F.col("lost") / F.col("n") + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
        if cut:
            next_ = cut(next_, "rank")
        rank = next_.drop("before")
        if tolerance is not None and (next_.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0) < tolerance:
            break
    return rank.select("id", "rank")


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, cut=None) -> DataFrame:
    """(id, depth, parent): each node once, at its least depth, by the smallest parent of that depth."""
    seen = seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
        front = step.select(F.col("dst").alias("id"), F.lit(k).alias("depth"), "parent").join(seen.select("id"), "id", "left_anti")
        front = cut(front, "front") if cut else front
        seen = seen.union(front)
    return seen


def one_hop(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed nodes and all that an edge joins them with."""
    ids = changed.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("dst")
    into = edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src")
    return ids.union(out).union(into).distinct()


def neighbours(edges: DataFrame, names: DataFrame, incoming: bool = True) -> DataFrame:
    """Edges with the names of both ends; those with an unknown end are left out."""
    a, b = names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return edges.join(a, "src").join(b, "dst")


def descend(children: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, depth) of a tree or graph given as (parent, child), without a set of visited nodes."""
    level = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        level = level.join(children, F.col("id") == F.col("parent")).select("root", F.col("child").alias("id"), F.lit(k).alias("depth"))
        out = out.union(level)
    return out


def cluster_metrics(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, size, intra, leaving, cohesion, separation); zero where a denominator is."""
    own = edges.join(members.select(F.col("id").alias("src"), F.col("cluster")), "src").join(members.select(F.col("id").alias("dst"), F.col("cluster").alias("other")), "dst", "left")
    counts = own.groupBy("cluster").agg(F.count_if(F.col("cluster").eqNullSafe(F.col("other"))).alias("intra"), F.count_if(~F.col("cluster").eqNullSafe(F.col("other"))).alias("leaving"))
    sized = members.groupBy("cluster").agg(F.count("*").alias("size")).join(counts, "cluster", "left").fillna(0, ["intra", "leaving"])
    pairs, ends = F.col("size") * (F.col("size") - 1), 2 * F.col("intra") + F.col("leaving")
    return sized.select("cluster", "size", "intra", "leaving", F.when(pairs > 0, F.col("intra") / pairs).otherwise(0.0).alias("cohesion"), F.when(ends > 0, F.col("leaving") / ends).otherwise(0.0).alias("separation"))


def dominant_kinds(edges: DataFrame, members: DataFrame, top: int = 3) -> DataFrame:
    own = edges.join(members.select(F.col("id").alias("src"), "cluster"), "src").groupBy("cluster", "kind").agg(F.count("*").alias("n"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "kind"))).where(F.col("place") <= top)


def propagate_labels(edges: DataFrame, nodes: DataFrame, rounds: int = 20, cut=None) -> DataFrame:
    """(id, label): each round a node takes the label of most weight about it, the smallest at ties; all at once."""
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    now = nodes.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = both.join(now, F.col("dst") == F.col("id")).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("new"))
        next_ = now.join(best, now["id"] == best["src"], "left").select("id", F.coalesce("new", "label").alias("label"), F.col("label").alias("before"))
        if cut:
            next_ = cut(next_, "labels")
            if next_.where("label <> before").isEmpty():
                return next_.select("id", "label")
        now = next_.select("id", "label")
    return now


def topological_levels(phases: DataFrame, cut, most: int = 200) -> DataFrame:
    """(id, level) of phases (id, requires array); nodes on a cycle or behind one, or behind a missing id, have a null level."""
    # what is read is short on disk and long in memory, so joins are told not to broadcast it
    without = lambda rows, ids: rows.join(ids.hint("merge"), rows.columns[-1], "left_anti")
    needs = cut(phases.select("id", F.explode("requires").alias("need")), "needs")
    left, done = phases.select("id"), []
    for level in range(most):
        ready = cut(without(left, needs.select("id")), "level")
        if ready.isEmpty():
            break
        done.append(ready.select("id", F.lit(level).alias("level")))
        left = cut(without(left, ready), "left")
        needs = cut(without(needs, ready.withColumnRenamed("id", "need")).select("id", "need"), "needs")
    return reduce(DataFrame.union, [*done, left.select("id", F.lit(None).cast("int").alias("level"))])


def ranked_nodes(ranks: DataFrame, most: int = 0) -> DataFrame:
    """(id, rank), the highest first and smaller ids at ties; most = 0: all."""
    ordered = ranks.orderBy(F.desc("rank"), "id")
    return ordered.limit(most) if most else ordered


def enriched(edges: DataFrame, found: DataFrame, weight: float = 1.0) -> DataFrame:
    """Edges with what a language server found (file, target) added from the target to the file; a file does not point to itself."""
    more = found.where("file <> target").select(F.col("target").alias("src"), F.col("file").alias("dst"), F.lit(weight).alias("weight"))
    return accumulated(edges.select("src", "dst", "weight").union(more))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbour, outgoing, weight): every edge from both of its ends."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit(True).alias("outgoing"), "weight").union(edges.select("dst", "src", F.lit(False), "weight"))


def top_edges(edges: DataFrame, most: int) -> DataFrame:
    """The heaviest edges of each source, the smaller target at ties."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def phase_faults(phases: DataFrame, cut) -> DataFrame:
    """(id, fault) of phases (id, requires): `duplicate`, `missing` (required, not listed) and `cycle` (on one or behind one).

    What waits only for a missing phase is no cycle: missing ones count as done.
    """
    own = phases.select("id", "requires")
    twice = own.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("fault"))
    missing = missing_needs(own).select("id", F.lit("missing").alias("fault"))
    needs = own.select("id", F.explode("requires").alias("need")).distinct().join(missing.select(F.col("id").alias("need")), "need", "left_anti")
    known = needs.groupBy("id").agg(F.collect_set("need").alias("requires"))
    levels = topological_levels(own.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("requires", F.array().cast(phases.schema["requires"].dataType)).alias("requires")), cut)
    return twice.union(missing).union(levels.where("level is null").select("id", F.lit("cycle").alias("fault")))


def topological_order(phases: DataFrame, by: str, most: int = 100_000) -> DataFrame:
    """(by, id, place) of phases (by, id, requires): of those whose needs are all placed, the smallest id comes next.

    That choice depends on all before it, so a plan is one group's work; one of over `most` phases is an error. Needs
    outside a plan are passed over, phases on a cycle or behind one have no place. Duplicates count once.
    """
    kind = phases.schema["id"].dataType.simpleString()

    def order(frame):
        import heapq

        import pandas as pd

        if len(frame) > most:
            raise ValueError(f"a plan of {len(frame)} phases")
        needs, waits = {}, {}
        for phase, wanted in zip(frame["id"].tolist(), frame["requires"].tolist()):
            needs.setdefault(phase, set()).update(wanted if wanted is not None else ())
        for phase in needs:
            needs[phase] &= needs.keys()
            for need in needs[phase]:
                waits.setdefault(need, []).append(phase)
        ready, out = [p for p, wanted in needs.items() if not wanted], []
        heapq.heapify(ready)
        while ready:
            out.append(heapq.heappop(ready))
            for phase in waits.get(out[-1], ()):
                needs[phase].discard(out[-1])
                if not needs[phase]:
                    heapq.heappush(ready, phase)
        return pd.DataFrame({by: [frame[by].iloc[0]] * len(out), "id": out, "place": range(1, len(out) + 1)})

    return phases.select(by, "id", "requires").groupBy(by).applyInPandas(order, f"{by} {phases.schema[by].dataType.simpleString()}, id {kind}, place int")


def missing_needs(phases: DataFrame) -> DataFrame:
    return phases.select(F.explode("requires").alias("id")).distinct().join(phases.select("id"), "id", "left_anti")
