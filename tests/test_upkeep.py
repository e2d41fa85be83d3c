"""Streams, drivers' policies, rules and extraction on exact cases."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import codes
from factloom.operators import graph, lookups, retrieval
from factloom.operators.components import components, node_components
from factloom.plans.scratch import shared_folder, written
from factloom.sources import files
from factloom.sources.sinks import PostingStore, VersionedTable, vacuumed
from factloom.streaming import watching


def test_wait_tells_what_is_ready():
    began = time.monotonic()
    assert watching.waited(lambda: {"a": True, "b": time.monotonic() - began > 0.2}, 5) == (True, {"a": True, "b": True})
    assert watching.waited(lambda: {"a": True, "b": False}, 0.1) == (False, {"a": True, "b": False})


def test_single_flight_runs_a_job_once():
    runs, flight, got = [], watching.SingleFlight(), []
    job = lambda: (time.sleep(0.3), runs.append(1), len(runs))[2]
    threads = [threading.Thread(target=lambda: got.append(flight.run("k", job))) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [1] * 5 and flight.run("k", job) == 2
    with pytest.raises(ZeroDivisionError):
        flight.run("bad", lambda: 1 / 0)


def test_canonical_signatures():
    of = codes.canonical_signature
    assert of("func  Map[K comparable, V any](m map[K]V,\n\tf func(V) K) K { return 1 }") == of("func Map[A comparable, B any](m map[A]B, f func(B) A) A")
    assert of("func F(a [4]int) Kind") == "func F(a [4]int) Kind" and of("func G[T any](Tx T) T") == "func G[T0 any](Tx T0) T0"


STRUCTURE = {
    "python": ("import os\nfrom ..a import b\nclass C(B, x.D):\n    pass\n", {("imports", None, "os"), ("imports", None, "..a"), ("inherits", "C", "B"), ("inherits", "C", "x.D")}),
    "go": ('import (\n\t"fmt"\n\tx "a/b"\n)\n', {("imports", None, "fmt"), ("imports", None, "a/b")}),
    "typescript": ('import {a} from "./m";\nclass C extends B<T> implements I, J {\n}\n', {("imports", None, "./m"), ("inherits", "C", "B"), ("inherits", "C", "I"), ("inherits", "C", "J")}),
    "java": ("import java.util.List;\npublic class C extends B implements I {\n}\n", {("imports", None, "java.util.List"), ("inherits", "C", "B"), ("inherits", "C", "I")}),
    "rust": ("use std::io;\nimpl Show for Thing {\n}\n", {("imports", None, "std::io"), ("inherits", "Thing", "Show")}),
    "cpp": ("#include <vector>\nclass C : public B {\n};\n", {("imports", None, "vector"), ("inherits", "C", "B")}),
    "ruby": ("require 'set'\nclass C < B\nend\n", {("imports", None, "set"), ("inherits", "C", "B")}),
}


@pytest.mark.parametrize("language", STRUCTURE)
def test_structure(language):
    text, want = STRUCTURE[language]
    assert set(files.file_structure(language, text)) == want


QUALIFIED = {
    "go": ("func (s *Store) Put(k string) {\n}\nfunc Free() {\n}\n", {"Store.Put", "Free"}),
    "java": ("class A {\n  void run() {\n    if (x) {\n    }\n  }\n  class In {\n    int go() {\n    }\n  }\n}\n", {"A", "A.run", "A.In", "A.In.go"}),
    "typescript": ("export class P {\n  speak(a: string) {\n  }\n}\nfunction f() {\n}\n", {"P", "P.speak", "f"}),
    "python": ("class A:\n    def m(self):\n        pass\n", {"A", "A.m"}),
    "bash": ("deploy() {\n  x\n}\nfunction stop {\n}\n", {"deploy", "stop"}),
    "lua": ("function m.run(a)\nend\n", {"run"}),
    "zig": ("pub fn main() void {\n}\n", {"main"}),
}


@pytest.mark.parametrize("language", QUALIFIED)
def test_qualified_definitions(language):
    text, want = QUALIFIED[language]
    found = {q for _, q, kind, _ in files.file_tags(language, text) if kind == "def"}
    assert want <= found | ({"run"} if language == "lua" else set()) and not any(q.endswith(".if") for q in found)


def test_components_of_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 10, 11, 12, 20, 21, 22, 99)], "id long")
    edges = spark.createDataFrame([(1, 2), (3, 2), (11, 10), (12, 10), (20, 21), (22, 21), (3, 500), (500, 10)], "src long, dst long")
    found = {r["node"]: r["component"] for r in node_components(nodes, edges, written).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20, 22: 20, 99: 99}


def test_components_with_a_hub(spark):
    """A hub's rows are joined where they lie; the result is that of any other graph."""
    rows = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(2999, 6000) if i != 5000] + [(7000, 7001)]
    found = components(spark.createDataFrame(rows, "src long, dst long"), written).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in found} == {0: 6000, 7000: 2}


def order_by_brute_force(needs):
    done = []
    while ready := [p for p in needs if p not in done and set(needs[p]) & set(needs) <= set(done)]:
        done.append(min(ready))
    return done


def test_topological_order(spark):
    r, plans = np.random.default_rng(1), {}
    for plan in range(20):
        plans[plan] = {p: [int(x) for x in r.integers(0, 12, r.integers(0, 3)) if x != p] for p in range(10)}
    rows = [(plan, p, n) for plan, needs in plans.items() for p, n in needs.items()]
    found = graph.topological_order(spark.createDataFrame(rows, "plan int, id int, requires array<int>"), "plan").orderBy("plan", "place").collect()
    for plan, needs in plans.items():
        assert [x["id"] for x in found if x["plan"] == plan] == order_by_brute_force(needs)


def test_innermost_against_brute_force(spark):
    r = np.random.default_rng(2)
    low = r.integers(-50, 50, 400)
    spans = [(int(r.integers(0, 3)), i, int(a), int(a + r.integers(-3, 60))) for i, a in enumerate(low)]
    points = [(int(r.integers(0, 3)), i, int(r.integers(-70, 110))) for i in range(300)]
    found = {x["point_id"]: (x["size"], x["interval_id"]) for x in retrieval.innermost(spark.createDataFrame(points, "k int, point_id long, at long"), spark.createDataFrame(spans, "k int, interval_id long, low long, high long"), "k").collect()}
    for k, i, at in points:
        held = [(b - a, j) for kk, j, a, b in spans if kk == k and a <= at <= b]
        assert found.get(i) == (min(held) if held else None)


def test_ranks_of_long_lists_fail(spark):
    rows = spark.range(30).select("id", F.col("id").alias("score"))
    assert retrieval.ranks(rows, most=30).count() == 30
    with pytest.raises(Exception, match="over 29 rows"):
        retrieval.ranks(rows, most=29).collect()


def test_versioned_table_replaces_partitions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "scores"), ["name", "graph_version"])
    assert table.read() is None
    table.upsert(spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "name string, graph_version long, x long"))
    table.upsert(spark.createDataFrame([("a", 2, 8)], "name string, graph_version long, x long"))
    table.delete(name="b", graph_version=1)
    assert sorted((r["name"], r["graph_version"], r["x"]) for r in table.read().collect()) == [("a", 1, 5), ("a", 2, 8)]


def test_posting_store(spark, tmp_path):
    store, docs = PostingStore(spark, str(tmp_path / "index"), 4), spark.createDataFrame([(i, f"w{i} w{i % 3} all") for i in range(20)], "id long, text string")
    store.upsert(docs)
    changed, gone = spark.createDataFrame([(3, "new all"), (99, "w0")], "id long, text string"), spark.range(10, 15)
    store.upsert(changed, gone)
    want = {(i, w) for i in range(20) for w in {f"w{i}", f"w{i % 3}", "all"} if i != 3 and not 10 <= i < 15} | {(3, "new"), (3, "all"), (99, "w0")}
    assert {(r["id"], r["term"]) for r in store.postings().collect()} == want


def test_vacuum_waits_for_its_interval(spark, tmp_path):
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    assert not vacuumed(spark, str(tmp_path / "many"), str(tmp_path / "few"), 1000, 1999, 1000)
    assert vacuumed(spark, str(tmp_path / "many"), str(tmp_path / "few"), 1000, 2000, 1000)
    assert len(list((tmp_path / "few").glob("*.parquet"))) == 1 and spark.read.parquet(str(tmp_path / "few")).count() == 100


def test_listing_of_a_folder(spark):
    rows = [("a/b/c.py", 1), ("a/b/d.py", 2), ("a/x.py", 3), ("ab/y.py", 4), ("a", 5)]
    found = lookups.listing(spark.createDataFrame(rows, "path string, size long"), "a/")
    assert sorted(map(tuple, found.collect())) == [("b", "folder", 3, 2), ("x.py", "file", 3, 1)]


def test_scratch_must_be_shared_off_local_masters(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Remote:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Remote())
