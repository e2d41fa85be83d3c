"""Queries over all edges of lineitem against brute force, on a small table with several components."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from factloom.operators import labels
from factloom.operators.components import dense_components, ends_of, pairs_of, sampled_components
from factloom.plans import registry
from factloom.plans.scratch import written

PART = 1_000_000_000


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r, d = np.random.default_rng(3), str(tmp_path_factory.mktemp("small"))
    rows = [(int(10 * g + r.integers(0, 4)), int(20 * g + r.integers(0, 6)), float(r.integers(1, 51))) for g in range(30) for _ in range(g % 9 + 1)]
    rows += [(1000 + k // 2, 2000 + (k + 1) // 2, 30.0) for k in range(60)]  # a long path, which takes many rounds
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    around = defaultdict(set)
    for s, p, _ in rows:
        around[s].add(PART + p)
        around[PART + p].add(s)
    return d, around


def components_by_brute_force(around):
    label = {x: x for x in around}
    for _ in around:
        label = {x: min(label[x], *(label[y] for y in around[x])) for x in around}
    return label


def test_components(spark, small):
    d, around = small
    want = components_by_brute_force(around)
    assert {r["node"]: r["component"] for r in registry.queries()["weak_components_whole"](spark, d).collect()} == want
    sizes = sorted(Counter(want.values()).items(), key=lambda x: (-x[1], x[0]))
    assert len(sizes) > 20 and [tuple(r) for r in registry.queries()["component_sizes_topn_whole"](spark, d).collect()] == sizes[:20]


def labels_by_brute_force(around, weight, colour, rounds=20):
    """One node after another, by colour and id."""
    label = {x: x for x in around}
    for k in range(rounds):
        before = dict(label)
        for x in sorted(around, key=lambda x: (colour[x], x)):
            votes = Counter()
            for y in around[x]:
                votes[label[y]] += weight[x, y]
            if votes:
                label[x] = min(votes, key=lambda k: (-votes[k], k))
        if label == before:
            return label, k
    return label, rounds


def test_label_propagation(spark, small, monkeypatch):
    d, around = small
    monkeypatch.setattr(labels, "MOST_MEMBERS", 12)
    monkeypatch.setattr(labels, "ROUNDS", 4)  # the long path would take many more to settle
    edges = registry.queries()["label_propagation"](spark, d)
    nodes = [(x,) for x in around]
    pairs = [(x, y) for x in around for y in around[x] if x < y]
    # the colours depend on ids alone, but for those of other components
    component = components_by_brute_force(around)
    sizes = Counter(component.values())
    large = {x for x in around if sizes[component[x]] > 12}
    colour = colours(spark, [(x,) for x in large], [p for p in pairs if p[0] in large])
    want, _ = labels_by_brute_force({x: around[x] for x in large}, Counter({(x, y): 1 for x in around for y in around[x]}), colour, 4)
    found = {r["id"]: (r["component"], r["label"]) for r in edges.collect()}
    assert len(nodes) == len(found) and large and len(large) < len(nodes)
    assert found == {x: (component[x], want.get(x, component[x])) for x in around}


def colours(spark, nodes, pairs):
    found = labels.coloured(spark.createDataFrame(nodes, "id long"), spark.createDataFrame(pairs, "src long, dst long"), written).collect()
    assert len(found) == len(nodes)
    colour = {r["id"]: r["colour"] for r in found}
    assert all(colour[x] != colour[y] for x, y in pairs if x != y)
    return colour


def test_labels_of_one_edge_settle(spark):
    """All at once, the two would swap labels for ever."""
    found = labels.settled_labels(spark.range(1, 3), spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double"), written).collect()
    assert {r["label"] for r in found} in ({1}, {2})
    assert {r["id"]: r["label"] for r in labels.settled_labels(spark.range(1, 3), spark.createDataFrame([], "src long, dst long, weight double"), written).collect()} == {1: 1, 2: 2}
    assert labels.split_components(spark.range(0), spark.createDataFrame([], "src long, dst long, weight double"), written).count() == 0


def test_labels_against_brute_force(spark):
    r = np.random.default_rng(9)
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(r.integers(0, 60, 150), r.integers(0, 60, 150), r.integers(1, 4, 150))] + [(0, k, 1.0) for k in range(1, 40)] + [(5, 5, 9.0), (999, 1, 5.0)]
    nodes, around, weight = range(60), defaultdict(set), Counter()
    for a, b, w in pairs:
        if a != b and a < 60 and b < 60:
            around[a].add(b)
            around[b].add(a)
            weight[a, b] += w
            weight[b, a] += w
    colour = colours(spark, [(x,) for x in nodes], [(a, b) for a in around for b in around[a] if a < b])
    want, rounds = labels_by_brute_force({x: around[x] for x in nodes}, weight, colour)
    found = labels.settled_labels(spark.range(60), spark.createDataFrame(pairs, "src long, dst long, weight double"), written)
    assert {x["id"]: x["label"] for x in found.collect()} == want and rounds < 19


def test_labels_meet_an_edge_a_few_times(spark):
    """Rounds ran on all edges, both ways, and every join dealt and sorted them anew: components by stars over every edge, colours by joins at both ends."""
    edges = spark.range(40_000).selectExpr("id % 100 AS src", "1000 + id * 7 % 3001 AS dst", "1.0D AS weight").distinct()
    dealt, many = [], edges.count() // 2

    def cut(df, name):
        out = written(df, name)
        rows = out.count()
        dealt.append((name, rows, df._jdf.queryExecution().executedPlan().toString()))
        return out

    found = labels.split_components(None, edges, cut, most=50)
    assert found.count() == 3101
    large = [name for name, rows, _ in dealt if rows > many]
    assert large == ["pairs", "arcs"]  # what was made of all edges, each once
    assert all("SortMergeJoin" not in p for name, _, p in dealt if name == "arcs")


def test_components_that_a_sample_leaves_apart(spark):
    """Two nodes whose smallest and largest neighbours are their own, joined by a middle one alone; loops, edges with one end, and twice the same."""
    pairs = [(10, 1), (10, 50), (10, 30), (30, 2), (30, 90), (60, 60), (None, 70), (80, None), (10, 1), (1, 10)]
    edges = spark.createDataFrame([(*p, 1.0) for p in pairs], "src long, dst long, weight double")
    want = {1: 1, 2: 1, 10: 1, 30: 1, 50: 1, 90: 1, 60: 60, 70: 70, 80: 80}
    assert {r["node"]: r["component"] for r in dense_components(edges, written).collect()} == {x: c for x, c in want.items() if x < 60 or x == 90}
    found = labels.split_components(None, edges, written, most=5)
    assert {r["id"]: r["component"] for r in found.collect()} == want
    parts = sampled_components(ends_of(pairs_of(None, edges)), written)
    assert {r["component"] for r in parts.where("id in (10, 30)").collect()} == {1, 2}


def test_colours_between_hubs_and_leaves(spark):
    """A clique with tails: most nodes are neither first nor last."""
    pairs = [(a, b) for a in range(6) for b in range(a)] + [(a, 10 + a) for a in range(6)] + [(10 + a, 20 + a) for a in range(6)]
    colour = colours(spark, [(x,) for x in {y for p in pairs for y in p}], pairs)
    assert {colour[x] for x in range(6)} == set(range(6))
