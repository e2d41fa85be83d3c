"""Repairs as transactions: applied once, whole or not at all."""

import pytest

from factloom.streaming.repairing import RepairedGraph

EDGES, REPAIRS = "src long, dst long, kind string", "op string, id long, src long, dst long, kind string"


def rows_of(graph):
    return sorted(tuple(r) for r in graph.edges().collect())


def graph_of(spark, tmp_path):
    graph = RepairedGraph(spark, str(tmp_path / "graph"))
    assert graph.version() == 0
    with pytest.raises(ValueError):
        graph.edges()
    graph.start(spark.createDataFrame([(1, 2, "A"), (2, 3, "A"), (3, 1, "B"), (4, 5, "A"), (4, 5, "A")], EDGES))
    return graph


def test_a_batch_counts_once(spark, tmp_path):
    graph = graph_of(spark, tmp_path)
    graph.start(spark.createDataFrame([], EDGES))  # it has a commit already
    gone, fresh = spark.createDataFrame([(3,), (None,)], "id long"), spark.createDataFrame([(1, 2, "A"), (5, 6, "C"), (3, 9, "C")], EDGES)
    assert graph.version() == 1 and graph.apply("b1", gone, fresh) == (2, True)
    want = [(1, 2, "A"), (4, 5, "A"), (5, 6, "C")]
    assert rows_of(graph) == want and graph.apply("b1", gone, fresh) == (2, False)
    assert rows_of(graph) == want and graph.ledger().count() == 2
    # an empty repair moves no version, and its batch is known
    assert graph.apply("b2", gone.limit(0), fresh.limit(0)) == (2, False) and graph.ledger().where("batch = 'b2'").count() == 1


def test_a_broken_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    graph = graph_of(spark, tmp_path)
    monkeypatch.setattr(RepairedGraph, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        graph.apply("b1", spark.range(1, 2), spark.createDataFrame([], EDGES))
    monkeypatch.undo()
    assert graph.version() == 1 and len(rows_of(graph)) == 4
    assert graph.apply("b1", spark.range(1, 2), spark.createDataFrame([], EDGES)) == (2, True) and rows_of(graph) == [(2, 3, "A"), (4, 5, "A")]


def test_a_stream_of_repairs(spark, tmp_path):
    graph = graph_of(spark, tmp_path)
    spark.createDataFrame([("remove", 4, None, None, None), ("upsert", None, 7, 8, "A")], REPAIRS).coalesce(1).write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(REPAIRS).json(str(tmp_path / "in"))
    graph.follow(stream(), str(tmp_path / "ck"))
    assert graph.version() == 2 and rows_of(graph) == [(1, 2, "A"), (2, 3, "A"), (3, 1, "B"), (7, 8, "A")]
    graph.follow(stream(), str(tmp_path / "other-ck"))  # the checkpoint was lost: the same batch comes again
    assert graph.version() == 2 and graph.ledger().count() == 2
    spark.createDataFrame([("upsert", None, 9, 9, "A")], REPAIRS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    graph.follow(stream(), str(tmp_path / "ck"))
    assert graph.version() == 3 and (9, 9, "A") in rows_of(graph)
