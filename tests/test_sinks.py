"""Writers, by what is read back."""

import pytest

from factloom.sources import sinks


def test_partitions_are_replaced_and_dropped(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "scores"), ["score_name", "graph_version"])
    assert table.read() is None
    schema = "id long, score double, score_name string, graph_version long"
    table.upsert(spark.createDataFrame([(1, 0.5, "rank", 1), (2, 0.5, "rank", 1), (1, 0.1, "rank", 2)], schema))
    table.upsert(spark.createDataFrame([(1, 0.9, "rank", 2)], schema))
    assert sorted((r["id"], r["score"], r["graph_version"]) for r in table.read().collect()) == [(1, 0.5, 1), (1, 0.9, 2), (2, 0.5, 1)]
    assert {r["graph_version"] for r in sinks.latest_version_at_most(table.read(), "score_name", 7).collect()} == {2}
    table.delete(score_name="rank", graph_version=1)
    assert [(r["id"], r["score"]) for r in table.read().collect()] == [(1, 0.9)]
    assert {r["status"] for r in sinks.marked_stale(table.read()).collect()} == {"stale"}


def test_cache_and_symbols(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "path string, modified long")
    assert {r["path"] for r in sinks.cache_misses(seen, spark.createDataFrame([("a", 1), ("b", 1)], "path string, modified long")).collect()} == {"b", "c"}
    trees = spark.createDataFrame([("f", 1, None, "A"), ("f", 2, 1, "run"), ("f", 3, 2, "inner"), ("g", 1, None, "B")], "file string, id long, parent long, name string")
    assert {(r["file"], r["qualified"]) for r in sinks.flattened_symbols(trees).collect()} == {("f", "A"), ("f", "A.run"), ("f", "A.run.inner"), ("g", "B")}
    with pytest.raises(ValueError):
        sinks.flattened_symbols(trees, 1)


def test_notes(spark):
    notes = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, content string")
    edits = spark.createDataFrame([("a", 1, "save", "x", None), ("a", 2, "save", "y", None), ("b", 3, "rename", None, "z"), ("c", 4, "delete", None, None), ("n", 5, "save", "new", None)], "name string, ordinal long, op string, content string, new_name string")
    assert {tuple(r) for r in sinks.notes_after(notes, edits).collect()} == {("a", "y"), ("z", "2"), ("n", "new")}
    assert sinks.notes_after(notes, edits.limit(0)).count() == 3


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([("a|b", 0.5), (None, None)], "mode string, rate double").orderBy("mode")
    assert sinks.markdown(frame) == "| mode | rate |\n|---|---|\n|  |  |\n| a\\|b | 0.5 |\n"
    with pytest.raises(ValueError):
        sinks.markdown(frame, 1)
    sinks.written_json(frame, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    edges = spark.createDataFrame([("b", 'a"'), ("a", "b"), ("a", "b")], "src string, dst string")
    assert sinks.dot(edges) == 'digraph {\n  "a" -> "b";\n  "b" -> "a\\"";\n}\n'
    frame.write.parquet(str(tmp_path / "many"))
    sinks.compacted_files(spark, str(tmp_path / "many"), str(tmp_path / "few"))
    assert spark.read.parquet(str(tmp_path / "few")).count() == 2
