"""Small cases of what larger tables and odd inputs showed."""

import time

import pandas as pd
from pyspark.sql import functions as F

from factloom import api
from factloom.functions import codes
from factloom.llm import near_dedup, suffix_dedup
from factloom.operators import components, graph, retrieval
from factloom.plans.scratch import shared_folder, written
from factloom.sources.term_index import TermIndex
from factloom.streaming import receipts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_explanation_can_show_all(spark):
    edges = frame(spark, [(k, 0) for k in range(1, 301)] + [(0, k) for k in range(301, 601)], "src long, dst long")
    names = spark.range(601).select("id", F.concat(F.lit("n"), "id").alias("name"))
    clusters = spark.range(601).select("id", F.lit(1).cast("long").alias("cluster"))
    count = lambda df: {r["aspect"]: r["count"] for r in df.groupBy("aspect").count().collect()}
    assert count(api.explain(names, edges, clusters, 0)) == {"caller": 50, "callee": 100, "cluster": 1}
    assert count(api.explain(names, edges, clusters, 0, most_callers=None, most_edges=None)) == {"caller": 300, "callee": 300, "cluster": 1}


def test_a_margin_is_worked_out_once(spark):
    own = frame(spark, [(["   a", "", "  b"],), (["\t x", "\t  y"],), (["a", "  b"],), (["", " "],)], "l array<string>")
    found = own.select(codes.dedented("l", codes.common_margin("l")).alias("d"))
    assert plan(found).count("array_min(") == 1
    assert [r["d"] for r in found.collect()] == [[" a", "", "b"], ["x", " y"], ["a", "  b"], ["", ""]]


def test_definitions_of_a_file_meet_references_once(spark):
    # 60,000 definitions of one name in two files and 400 referring files: 24 million rows if each definition met each file
    definitions = spark.range(60_000).select((F.col("id") % 2).alias("file"), F.lit("a").alias("name")).union(frame(spark, [(7, "b"), (7, "b")], "file long, name string"))
    references = spark.range(400).select((F.col("id") + 100).alias("file"), F.lit("a").alias("name")).union(frame(spark, [(0, "a")], "file long, name string"))
    for most in (10, 0):
        edges = graph.reference_graph(definitions, references, most_broadcast=most)
        rows = {(r["src"], r["dst"]): round(r["weight"], 9) for r in edges.collect()}
        each = round(30_000 / 60_001**0.5, 9)
        assert rows == {(s, d): each for s in range(100, 500) for d in (0, 1)} | {(0, 1): each, (7, 7): 0.2}
        assert "count(1) AS held" in plan(edges)


def test_queries_of_many_terms(spark):
    index = TermIndex(spark, f"{shared_folder(spark)}/many-terms", ["a"], buckets=4)
    index.build(frame(spark, [(1, "w7 w8"), (2, "w10400 x"), (3, "x")], "id long, a string"))
    queries = spark.range(10_500).select((F.col("id") % 50).alias("query"), F.concat(F.lit("w"), "id").alias("term"))
    assert {(r["query"], r["id"]) for r in index.search(queries, 5).collect()} == {(7, 1), (8, 1), (0, 2)}


def test_only_words_that_are_asked_for_leave_their_rows(spark):
    texts = frame(spark, [(1, "a B c"), (1, "a"), (2, "x y z z"), (3, ""), (4, None), (5, "b-b")], "id long, text string")
    found = retrieval.bm25(texts, ["a", "b"], 5, 6)
    assert found.collect() == retrieval.bm25(retrieval.postings(texts), ["a", "b"], 5, 6).collect()
    assert [r["id"] for r in found.collect()] == [1, 5] or [r["id"] for r in found.collect()] == [5, 1]
    assert all("filter(" in line for line in plan(found).split("\n") if "Generate explode" in line)
    fields = frame(spark, [(1, "a", "b b"), (2, None, "a"), (3, "c", "")], "id long, f string, g string")
    both = [retrieval.match_any(x, ["a", "b"], 5, [1], 0.5).collect() for x in (retrieval.field_texts(fields, ["f", "g"]), retrieval.field_postings(fields, ["f", "g"]))]
    assert both[0] == both[1] and len(both[0]) == 2


def test_levels_are_not_broadcast(spark):
    plans = []

    def cut(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    phases = frame(spark, [(1, []), (2, [1]), (3, [1, 2]), (4, [9]), (5, [6]), (6, [5]), (7, [5])], "id long, requires array<long>")
    assert {(r["id"], r["level"]) for r in graph.topological_levels(phases, cut).collect()} == {(1, 0), (2, 1), (3, 2), (4, None), (5, None), (6, None), (7, None)}
    assert not any("Broadcast" in p for p in plans)


class _State(dict):
    """A map or a value of a state store, which counts its accesses."""

    writes = 0

    def iterator(self):
        return iter([((k,), v) for k, v in self.items()])

    def updateValue(self, key, value):
        self[key[0]], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self[key[0]]
        self.writes += 1

    def exists(self):
        return bool(self)

    def get(self):
        return (self["v"],)

    def update(self, value):
        self["v"] = value[0]


def test_receipts_write_what_a_batch_leaves(spark):
    store = receipts.ReceiptStore(1_000_000_000, 3)
    store.held, store.count, store._wait = _State(), _State(), lambda now: None
    rows = lambda n, m: pd.DataFrame({"at": pd.to_datetime(range(n, m), unit="s"), "ord": range(n, m), "op": "issue", "receipt": [str(k) for k in range(n, m)], "version": 1})
    for low, high in ((0, 100), (100, 102)):
        out = next(store.handleInputRows(("w",), iter([rows(low, high)]), None))
        assert (out["outcome"] == "issued").sum() == high - low
        assert [v[0] for v in store.held.values()] == [str(k) for k in range(high - 3, high)]
    assert store.held.writes == 3 + 4


def test_ranks_go_to_blocks_of_targets(spark, monkeypatch):
    """A row for each edge was dealt twice in each round."""
    monkeypatch.setattr(graph, "LEAST_BLOCKS", 2)
    # two hubs of 400 targets, of unlike weights, back from every third of these; 500 has no way out
    rows = [(h, 100 + k, 1.0 + k % 2) for h in (1, 2) for k in range(400)] + [(100 + k, 1 + k % 2, 2.0) for k in range(0, 400, 3)] + [(1, 2, 0.0), (None, 7, 1.0), (7, None, 1.0), (7, 7, 1.0)]
    edges, nodes = frame(spark, rows, "src long, dst long, weight double"), frame(spark, [(1,), (2,), (7,), *((100 + k,) for k in range(400))], "id long")
    moves = []

    def cut(df, name):
        out = written(df, name)
        moves.extend(out.collect() if name == "moves" else [])
        return out

    rank, kept = {r["id"]: 1 / 403 for r in nodes.collect()}, [(s, d, w) for s, d, w in rows if w and s and d]
    total = {s: sum(w for x, _, w in kept if x == s) for s, _, _ in kept}
    for _ in range(3):
        lost, flow = sum(r for x, r in rank.items() if x not in total), dict.fromkeys(rank, 0.0)
        for s, d, w in kept:
            flow[d] += rank[s] * w / total[s]
        rank = {x: 0.15 / 403 + 0.85 * (lost / 403 + flow[x]) for x in rank}
    for inside in (True, False):
        found = {r["id"]: r["rank"] for r in graph.pagerank(nodes, edges, 3, tolerance=None, cut=cut, inside=inside).collect()}
        assert found.keys() == rank.keys() and all(abs(found[x] - rank[x]) < 1e-12 for x in rank)
    plain = graph.pagerank(nodes, edges, 3, tolerance=None).collect()
    assert all(abs(r["rank"] - rank[r["id"]]) < 1e-12 for r in plain)
    hubs = [r for r in moves if r["src"] < 3]
    assert len(hubs) == 2 * 2 * 2 * 2 and {r["block"] for r in hubs} == {0, 1}  # for each hub, weight and block, twice
    assert all(r["block"] is None for r in moves if r["src"] > 2)


def test_plans_of_hot_keys_are_not_nested(spark, monkeypatch):
    """A round's joins are in plans of their own: one plan held 20 of them, and its text was megabytes for each job."""
    monkeypatch.setattr(components, "HOT_ROWS", 3)
    rows = [(50 * (i // 20), i) for i in range(200)] + [(i, i + 23) for i in range(0, 170, 10)]
    joins = []

    def cut(df, name):
        joins.append(plan(df).count("Join"))
        return written(df, name)

    found = {r["node"]: r["component"] for r in components.components(frame(spark, rows, "src long, dst long"), cut).collect()}
    want = {x: x for row in rows for x in row}
    for _ in want:
        for a, b in rows:
            want[a] = want[b] = min(want[a], want[b])
    assert found == want and 1 <= max(joins) <= 4


def test_copies_do_not_go_through_the_rounds(spark, monkeypatch):
    """Sixty copies of a text are no edges; a document of two texts connects both, also by its row without words."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(i, a) for i in range(10, 70)] + [(i, b) for i in range(100, 105)] + [(40, b), (40, None), (200, c), (201, c + " end"), (202, c + " end"), (300, "")]
    given, whole = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges, cut: given.append(edges.count()) or whole(edges, cut))
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()}
    first = {i: 10 if i < 200 else 200 if i < 300 else i for i, _ in rows}
    assert found == {(i, c, i == c) for i, c in first.items()} and max(given) <= 5


def test_shuffles_of_written_steps_go(spark):
    """Texts, runs and stretches once stood on disk together until the driver collected its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    text = " ".join(f"w{i}" for i in range(300))
    docs = frame(spark, [(i, text[i : i + 700] + f" {i}") for i in range(40)] + [(99, None)], "doc_id long, text string")

    def blocks():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before, was = blocks(), spark.conf.get(key)
    found = suffix_dedup.substring_dedup(docs)
    until = time.time() + 20
    while (left := blocks() - before) and time.time() < until:
        time.sleep(0.5)
    assert not left and spark.conf.get(key) == was
    assert found.count() == 41 and found.where("n_removed > 0").count() == 39
