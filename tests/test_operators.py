"""Small exact cases of the engine's operators."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import graph, retrieval, traces, versioned
from factloom.operators.components import components
from factloom.plans.scratch import written
from factloom.sources import files
from factloom.sources.snapshots import SnapshotStore
from factloom.streaming import changes

EDGES = [("a", "b", 1.0), ("a", "c", 0.5), ("b", "c", 1.0), ("b", "d", 0.25), ("c", "a", 0.75), ("c", "d", 0.5), ("d", "e", 1.0), ("e", "a", 0.5)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pagerank(spark):
    nodes, edges = frame(spark, [(x,) for x in "abcde"], "id string"), frame(spark, EDGES, "src string, dst string, weight double")
    rank = {r["id"]: round(r["rank"], 6) for r in graph.pagerank(nodes, edges, cut=written).collect()}
    assert rank == {"a": 0.279789, "b": 0.188547, "c": 0.237486, "d": 0.142798, "e": 0.151379}
    seeds = frame(spark, [("d", 1.0)], "id string, weight double")
    rank = {r["id"]: round(r["rank"], 6) for r in graph.pagerank(nodes, edges, seeds=seeds, cut=written).collect()}
    assert rank == {"a": 0.255174, "b": 0.144896, "c": 0.171126, "d": 0.231625, "e": 0.197179}


def test_pagerank_dangling_single_empty(spark):
    three = graph.pagerank(frame(spark, [("a",), ("b",), ("x",)], "id string"), frame(spark, [("a", "b", 1.0)], "src string, dst string, weight double"), cut=written)
    assert {r["id"]: round(r["rank"], 5) for r in three.collect()} == {"a": 0.25974, "b": 0.48052, "x": 0.25974}
    none = frame(spark, [], "src string, dst string, weight double")
    assert graph.pagerank(frame(spark, [("a",)], "id string"), none, cut=written).first()["rank"] == pytest.approx(1.0)
    assert graph.pagerank(frame(spark, [], "id string"), none, cut=written).count() == 0


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(300)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    found = {x["node"]: x["component"] for x in components(frame(spark, edges, "src long, dst long"), written).collect()}
    assert all(found.get(x, x) == find(x) for x in list(up))
    assert components(frame(spark, [], "src long, dst long"), written).count() == 0


def test_effective_view_and_priority(spark):
    base = frame(spark, [(10, 1.0), (11, 1.0), (12, 1.0)], "edge_id long, w double")
    over = frame(spark, [(11, 1.0, "deleted"), (12, 0.5, "live"), (13, 1.0, "live")], "edge_id long, w double, status string")
    assert {tuple(r) for r in versioned.effective(base, over, ["edge_id"]).collect()} == {(10, 1.0), (12, 0.5), (13, 1.0)}
    schema = "ordinal long, src long, dst long, kind string, source string, confidence double, validated boolean"
    one = versioned.priority_merge(frame(spark, [(1, 1, 2, "CALLS", "comment.x", 0.6, False), (2, 1, 3, "CALLS", "lsp.x", 1.0, True)], schema))
    assert [r["dst"] for r in one.collect()] == [3]
    two = versioned.priority_merge(frame(spark, [(1, 1, 3, "CALLS", "lsp.x", 1.0, True), (2, 1, 3, "CALLS", "comment.x", 0.6, False), (3, 1, 4, "CALLS", "comment.x", 0.6, False)], schema))
    assert sorted((r["dst"], r["source"]) for r in two.collect()) == [(3, "lsp.x"), (4, "comment.x")]


def test_fusion_and_packing(spark):
    text, near = frame(spark, [("A", 1), ("B", 2), ("C", 3)], "id string, rank int"), frame(spark, [("B", 1), ("D", 2)], "id string, rank int")
    rows = {r["id"]: r for r in retrieval.fuse(text, near).collect()}
    assert rows["B"]["score"] == pytest.approx(1 / 62 + 1 / 61) and (rows["D"]["first_rank"], rows["D"]["second_rank"]) == (0, 2)
    items = frame(spark, [("q", 1, 50), ("q", 2, 30), ("q", 3, 40), ("q", 4, 10)], "q string, place int, cost int")
    assert sorted(r["place"] for r in retrieval.packed(items, 64, "q", "place", "cost").collect()) == [1, 4]


def test_reference_graph_and_clusters(spark):
    defs = frame(spark, [("foo", "f1"), ("foo", "f2"), ("bar", "f2")], "name string, file string")
    refs = frame(spark, [("foo", "f3")] * 4 + [("foo", "f1")], "name string, file string")
    got = {(r["src"], r["dst"]): round(r["weight"], 6) for r in graph.reference_graph(defs, refs).collect()}
    assert got == {("f3", "f1"): 1.154701, ("f3", "f2"): 1.154701, ("f1", "f2"): 0.57735, ("f2", "f2"): 0.1}
    row = graph.cluster_metrics(frame(spark, [(1, 2), (2, 3), (3, 9)], "src long, dst long"), frame(spark, [(1, 0), (2, 0), (3, 0)], "id long, cluster long")).first()
    assert (row["cohesion"], row["separation"]) == (pytest.approx(2 / 6), pytest.approx(1 / 5))


def test_frontier_and_order(spark):
    edges = frame(spark, [(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert {r["id"] for r in graph.one_hop(edges, frame(spark, [(2,)], "id long")).collect()} == {1, 2, 3}
    phases = frame(spark, [("a", []), ("b", []), ("c", ["a", "b"]), ("d", ["c"]), ("x", ["y"]), ("y", ["x"]), ("k", ["z"])], "id string, requires array<string>")
    levels = {r["id"]: r["level"] for r in graph.topological_levels(phases, written).collect()}
    assert levels == {"a": 0, "b": 0, "c": 1, "d": 2, "x": None, "y": None, "k": None}
    assert [r["id"] for r in graph.missing_needs(phases).collect()] == ["z"]


@pytest.mark.parametrize(
    ("kinds", "left"),
    [(["modified", "modified"], "modified"), (["created", "created"], "created"), (["created", "modified"], "created"), (["created", "deleted"], None), (["modified", "deleted"], "deleted"), (["deleted", "created"], "modified"), (["created", "deleted", "created"], "created"), (["modified", "created"], "created")],
)
def test_coalescing(spark, kinds, left):
    events = frame(spark, [("p", k, i) for i, k in enumerate(kinds)], "path string, kind string, ord long").withColumn("at", F.timestamp_seconds("ord"))
    assert [r["kind"] for r in changes.coalesced(events).collect()] == ([left] if left else [])
    kind = None
    for k in kinds:
        kind = changes.merged(kind, k)
    assert kind == left


def test_bulk_and_gate(spark):
    batch = frame(spark, [(f"p{i:03}", "modified") for i in range(201)], "path string, kind string")
    row = changes.bulk_collapsed(batch).collect()
    assert len(row) == 1 and row[0]["kind"] == "bulk_update" and row[0]["paths"] == sorted(row[0]["paths"]) and len(row[0]["paths"]) == 201


def test_bulk_counts_keys(spark):
    rows = [(f"p{i % 3}", None, "modified", i, i) for i in range(300)] + [("p1", "p9", "renamed", 400, 400), ("p7", None, "created", 401, 401), ("p7", None, "deleted", 402, 402)]
    events = frame(spark, rows, "path string, old_path string, kind string, s long, ord long").withColumn("at", F.timestamp_seconds("s"))
    assert sorted((r["path"], r["kind"]) for r in changes.settled(events, 4).collect()) == [("p0", "modified"), ("p1", "modified"), ("p1", "renamed"), ("p2", "modified")]
    (row,) = changes.settled(events, 3).collect()
    assert (row["path"], row["kind"], row["paths"]) == (None, "bulk_update", ["p0", "p1", "p1", "p2"])


def test_stream_keeps_renames_apart(spark, tmp_path):
    rows = [("b", "a", "renamed", 0, 1), ("b", None, "created", 10, 2), ("b", "a", "renamed", 20, 3), ("c", None, "deleted", 30, 4), ("end", None, "modified", 900_000, 7)]
    schema = "path string, old_path string, kind string, ms long, ord long"
    frame(spark, rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).json(str(tmp_path / "in")).select("path", "old_path", "kind", F.timestamp_millis(F.col("ms") + 10_000_000).alias("at"), "ord")
    stream = changes.coalesced_stream(events).writeStream.format("memory").queryName("renames").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    got = sorted((r["path"], r["kind"]) for r in spark.table("renames").collect() if r["path"] != "end")
    assert got == [("b", "created"), ("b", "renamed"), ("c", "deleted")]


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [("p", "created", 0, 1), ("p", "modified", 100, 2), ("q", "created", 0, 3), ("q", "deleted", 50, 4), ("r", "modified", 0, 5), ("r", "modified", 5000, 6), ("end", "modified", 900_000, 7)]
    schema = "path string, kind string, ms long, ord long"
    frame(spark, rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).json(str(tmp_path / "in")).select("path", "kind", F.timestamp_millis(F.col("ms") + 10_000_000).alias("at"), "ord")
    stream = changes.coalesced_stream(events).writeStream.format("memory").queryName("coalesced").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    got = [(r["path"], r["kind"]) for r in spark.table("coalesced").orderBy("path", "at").collect() if r["path"] != "end"]
    assert got == [("p", "created"), ("r", "modified"), ("r", "modified")]


def test_tokens(spark):
    names = frame(spark, [("GetUserByID",), ("snake_case_id",), ("HTTPServer",), ("",)], "n string").select(scalars.identifier_tokens("n").alias("t")).collect()
    assert [r["t"] for r in names] == [["GetUserByID", "Get", "User", "By", "ID"], ["snake_case_id", "snake", "case", "id"], ["HTTPServer", "HTTP", "Server"], []]
    token = frame(spark, [("a:3:9",), ("a:x:9",), ("a:3",)], "t string").select(scalars.cluster_token_parts("t").alias("p")).collect()
    assert token[0]["p"]["cluster_id"] == 9 and token[1]["p"] is None and token[2]["p"] is None


def test_regressions(spark):
    pre = frame(spark, [(x, True, False) for x in "abcd"], "id string, passed boolean, skipped boolean")
    post = frame(spark, [("a", True, False), ("b", False, False), ("c", False, True)], "id string, passed boolean, skipped boolean")
    row = traces.regression_rate(pre, post, ["id"]).first()
    assert (row["regressed"], row["tests"]) == (2, 4)
    assert traces.regression_rate(pre.limit(0), post, ["id"]).first()["rate"] is None


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    first = store.begin()
    store.write(first, "edges", frame(spark, [(1, 1.0), (2, 1.0)], "edge_id long, w double"))
    assert store.latest() == 0
    store.commit(first)
    with pytest.raises(ValueError):
        store.commit(first)
    lost = store.begin()
    store.abort(lost)
    overlay = frame(spark, [(1, 5.0, "live", 1), (1, 9.0, "live", 2), (2, 0.0, "deleted", 2)], "edge_id long, w double, status string, write_epoch long")
    with pytest.raises(ValueError, match="over 1 rows"):
        store.compact("edges", overlay, ["edge_id"], most_rows=1)
    second, rest = store.compact("edges", overlay, ["edge_id"])
    assert store.latest() == second and [tuple(r) for r in store.read("edges").collect()] == [(1, 9.0)] and rest.isEmpty()
    third, _ = store.compact("edges", overlay.where("edge_id = 7"), ["edge_id"], keep=1)
    assert store.latest() == third and not (tmp_path / f"edges/snapshot_id={second}").exists()
    with pytest.raises(ValueError, match="dropped"):
        store.read("edges", second)
    assert [store.next("graph_version"), store.next("graph_version"), store.current("graph_version"), store.current("epoch")] == [1, 2, 2, 0]


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("class A:\n    def run(self):\n        return help(self)\n")
    (tmp_path / "src/b.go").write_text("package b\nfunc Run() { help() }\n")
    (tmp_path / "src/x.bin").write_bytes(b"\x00\x01")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.js").write_text("function c() {}")
    tree = files.walk(spark, str(tmp_path))
    assert tree.count() == 2 and files.find(tree, "**/*.py").count() == 1
    found = {(r["qualified"], r["kind"]) for r in files.tags(tree).collect()}
    assert {("A.run", "def"), ("A", "def"), ("help", "ref"), ("Run", "def")} <= found
    assert files.replaced(tree, "help", "aid").count() == 2
