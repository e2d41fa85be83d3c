"""Small exact cases of resolution, guards, fuzzy matching and composed questions."""

import pytest
from pyspark.sql import functions as F

from factloom import api
from factloom.operators import policy, resolve, retrieval, traces
from factloom.plans.scratch import written


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_type_signals(spark):
    cases = {
        ("var x Foo", "", ""): ("annotation", "Foo"),
        ("x *Bar", "", ""): ("annotation", "Bar"),
        ("x := NewBaz()", "", ""): ("constructor", "Baz"),
        ("y = x", "", ""): ("assignment", "x"),
        ("", "Foo returns the *Bar", ""): ("comment", "Bar"),
        ("", "", "userRepo"): ("heuristic", "UserRepository"),
        ("", "", "Repo"): None,
        ("", "", ""): None,
        (None, None, None): None,
    }
    rows = frame(spark, [(*k, i) for i, k in enumerate(cases)], "s string, c string, n string, i int").select("i", resolve.type_signals("s", "c", "n").alias("t")).orderBy("i").collect()
    assert [None if r["t"] is None else tuple(r["t"]) for r in rows] == list(cases.values())


def test_resolution_across_packages(spark):
    refs = frame(spark, [(1, "a/f.go", "var x Foo", "", ""), (2, "b/f.go", "var x Foo", "", ""), (3, "a/f.go", "", "", ""), (4, "a/f.go", "var x Nope", "", ""), (5, "b/f.go", "var x Foo", "", "")], "ref_id long, file string, signature string, comment string, name string")
    firm = frame(spark, [(5, 9)], "src long, dst long")
    types = frame(spark, [("Foo", 7, "a/t.go"), ("Foo", 8, "b/t.go")], "type_name string, type_id long, type_file string")
    got = {r["ref_id"]: tuple(r)[1:] for r in resolve.resolve(refs, firm, types).collect()}
    assert got == {1: (True, 7, 0.9, "annotation", "validated"), 2: (False, 7, 0.6, "annotation", "unresolved"), 3: (False, None, 0.2, "unknown", "unresolved"), 4: (True, None, 0.9, "annotation", "validated"), 5: (True, 9, 1.0, "lsp", "validated")}
    assert resolve.resolve(refs.limit(0), firm, types).count() == 0


def test_chains(spark):
    hops = frame(spark, [(1, True, 2, 0.9), (2, True, 3, 0.8), (3, False, None, 0.2)], "ref_id long, resolved boolean, target long, confidence double")
    requests = frame(spark, [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 0), (5, 1, 9), (6, 77, 1)], "req_id long, ref_id long, length int")
    got = {r["req_id"]: (r["resolved"], r["target"], r["reason"]) for r in resolve.walk_chains(requests, hops).collect()}
    assert got == {1: (True, 2, None), 2: (True, 3, None), 3: (False, None, None), 4: (False, None, "empty chain"), 5: (False, None, "chain too deep"), 6: (False, None, None)}


def test_fixpoint(spark):
    variables = frame(spark, [(1, True, "T")] + [(i, False, None) for i in range(2, 6)] + [(9, False, None)], "id long, resolved boolean, type string")
    flows = frame(spark, [(i, i + 1) for i in range(1, 5)], "src long, dst long")
    got = {r["id"]: r["type"] for r in resolve.assigned_types(variables, flows, written).collect()}
    assert got == {1: "T", 2: "T", 3: "T", 4: "T", 5: "T", 9: None}


def test_verdicts_and_exports(spark):
    edges = frame(spark, [(1, "a", "b", "C", 0.9), (1, "a", "c", "C", 0.9), (2, "a", "b", "C", 0.5), (3, "x", "y", "C", 0.7)], "impact long, src string, dst string, kind string, confidence double")
    verdicts = frame(spark, [("a", "b", "C", True), ("a", "c", "C", False)], "src string, dst string, kind string, confirmed boolean")
    assert {r["impact"]: (r["confidence"], r["refuted"]) for r in resolve.with_verdicts(edges, verdicts).collect()} == {1: (0.2, True), 2: (1.0, False), 3: (0.7, False)}
    keys = frame(spark, [("a/b:Open",), ("a:shut",), ("Top",), ("",), ("a:b:C",)], "k string").select(resolve.exported("k").alias("e"), resolve.package_of("k").alias("p")).collect()
    assert [(r["e"], r["p"]) for r in keys] == [(True, "a/b"), (False, "a"), (True, ""), (False, ""), (True, "a:b")]
    assert resolve.stored_kinds(["references", "contains"]) == ["REFERENCES", "IMPORTS", "CONTAINS", "DEFINED_IN"]


def test_guards(spark):
    edits = frame(spark, [(10, 1, 20, "load", ["load"]), (51, 1, 999, "lo", ["lo"]), (5, 2, 999, "x y", ["x y"]), (5, 1, 0, "gone", ["load"])], "lines int, files int, size int, find string, symbols array<string>")
    rows = edits.select(policy.large_edit("lines", "files").alias("a"), policy.large_edit("lines", "files", "size", True).alias("b"), policy.renames_by_text("find", "symbols").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(False, True, True), (True, True, False), (True, True, False), (False, False, False)]
    row = frame(spark, [("src/auth/login.go", "checkToken", ["fmt"])], "p string, n string, i array<string>").select(policy.security_signals("p", "n", "i", ["**/auth/**"], ["(?i)token"], ["^crypto/"]).alias("s")).first()
    assert row["s"] == ["path_glob", "identifier"]
    level = frame(spark, [(True, "", "block"), (True, "off", "block"), (False, "block", ""), (True, "", "")], "t boolean, a string, b string").select(policy.action("t", "a", "b").alias("x")).collect()
    assert [r["x"] for r in level] == ["block", "allow", "allow", "warn"]
    deletes = frame(spark, [(True, ["references_checked"]), (True, ["impact_checked"]), (False, ["references_checked"])], "e boolean, r array<string>").select(policy.unchecked_delete(F.lit(True), F.lit(True), "e", "r").alias("x")).collect()
    assert [r["x"] for r in deletes] == [True, False, False]


def test_windows(spark):
    docs = frame(spark, [(1, "a\nb\nc\nd", 1), (2, None, 1), (3, "x", 9)], "id long, text string, at int")
    assert {r["id"]: r["window"] for r in retrieval.window_about(docs, "at", 1).collect()} == {1: "a\nb", 2: "", 3: ""}
    twice = frame(spark, [(1, "a\n b\na\nb\na"), (2, None)], "id long, text string")
    assert [(r["id"], r["n"]) for r in retrieval.equal_windows(twice, ["a", "b"]).collect()] == [(1, 1), (1, 3)]
    assert retrieval.elided("def f():\n    x = 1\n    return x\ny = 2") == "def f():\n    ...\ny = 2"


def test_trace_numbers(spark):
    stat = frame(spark, [("a", "3\t4\tf"), ("a", "-\t-\tbin"), ("b", "x\t1\tf"), ("c", "-\t-\tbin"), ("d", "short")], "task string, line string")
    assert {r["task"]: r["distance"] for r in traces.patch_distance(stat, "task").collect()} == {"a": 7, "b": None, "c": 0, "d": 0}
    tracked = frame(spark, [("a", "f"), ("a", "g")], "task string, path string")
    changed = frame(spark, [("a", "f"), ("a", "new"), ("b", "z")], "task string, path string")
    assert {r["task"]: (r["modified"], r["locality"]) for r in traces.edit_locality(tracked, changed, "task").collect()} == {"a": (1, 0.5), "b": (0, None)}


def test_impact_cap_and_truncation(spark):
    edges = frame(spark, [(i, 0, "CALLS", 0.95) for i in range(1, 6)] + [(9, 1, "IMPORTS", 0.7)], "src long, dst long, kind string, confidence double")
    seeds = frame(spark, [(0,)], "id long")
    whole = api.change_impact(edges, seeds, 1, None, written).collect()
    assert len(whole) == 5 and {r["confidence"] for r in whole} == {0.95} and not whole[0]["truncated"]
    deep = api.change_impact(edges, seeds, 2, ["calls"], written, most_nodes=3).collect()
    assert len(deep) == 3 and {r["confidence"] for r in deep} == {0.6} and deep[0]["nodes"] == 6 and deep[0]["edges"] == 5 and deep[0]["truncated"]


def test_paths_and_budget(spark):
    paths = frame(spark, [("src/a",), ("doc/b",), ("",), (None,)], "p string").select(api.allowed_path(F.col("p"), ["src/"]).alias("x"), api.allowed_path(F.col("p"), []).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in paths] == [(True, True), (False, True), (False, True), (False, True)]
    ranked = frame(spark, [("a", 3.0, 500), ("b", 2.0, 10)], "path string, score double, cost long")
    assert [r["path"] for r in api.repo_map(ranked, 100).collect()] == ["a"]
    assert api.local_ranks(ranked.select(F.lit(1).cast("long").alias("id")), frame(spark, [(1, 2, 1.0)], "src long, dst long, weight double"), frame(spark, [(1,)], "id long"), most=1) is None


@pytest.mark.parametrize("moved", [False, True])
def test_recomputed_status(spark, moved):
    versions = iter([4, 5 if moved else 4])
    rows = api.recomputed(frame(spark, [(1,), (2,)], "id long"), frame(spark, [(1, 2, 1.0)], "src long, dst long, weight double"), lambda: next(versions), written, 5).collect()
    assert {(r["status"], r["graph_version"]) for r in rows} == {("approximate" if moved else "exact", 4)}
