"""Logs that grow and folders that change, drained again and again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.sources.growing import LogReader, resumed
from factloom.streaming import watching


def drain(stream, folder):
    rows = []
    watching.drained(stream, lambda batch, n: rows.extend(batch.collect()), str(folder))
    return rows


def test_appended_lines_come_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.log").write_text("one\ntwo\n")
    lines = lambda: [(r["file"].rpartition("/")[2], r["at"], r["line"]) for r in drain(watching.growing_log(spark, str(log)), tmp_path / "ck")]
    assert sorted(lines()) == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with open(log / "a.log", "a") as file:
        file.write("three\nfou")
    (log / "b.log").write_text("é\r\n")
    assert sorted(lines()) == [("a.log", 8, "three"), ("b.log", 0, "é")]
    assert lines() == []
    with open(log / "a.log", "a") as file:
        file.write("r\nfive\n")
    (log / "a.log").rename(log / "a.log.1")  # rotated: it is read on, and its successor from the start
    (log / "a.log").write_text("new\n")
    (log / ".hidden").write_text("no\n")
    assert sorted(lines()) == [("a.log", 0, "new"), ("a.log.1", 14, "four"), ("a.log.1", 19, "five")]
    (log / "a.log").write_text("cut\n")  # written anew in place
    assert lines() == [("a.log", 0, "cut")]


@pytest.mark.parametrize("block", [1, 7, 64, 100_000])
def test_ranges_share_out_every_line(tmp_path, block):
    r = random.Random(block)
    text = "".join("x" * r.choice([0, 1, 5, 90]) + "\n" for _ in range(60))
    (tmp_path / "a.log").write_text(text + "torn")
    reader = LogReader({"path": str(tmp_path), "block": block})
    end = json.loads(json.dumps(reader.latestOffset()))
    rows = [x for p in reader.partitions(reader.initialOffset(), end) for batch in reader.read(p) for x in batch.to_pylist()]
    assert [x["line"] for x in rows] == text.split("\n")[:-1]
    assert [x["at"] for x in rows] == [len("\n".join(text.split("\n")[:k])) + (k > 0) for k in range(60)]


def test_where_a_file_is_read_on():
    a, b = {"head": "a", "end": 10}, {"head": "b", "end": 4}
    assert resumed("x", {"head": "a", "end": 12}, {"x": a}, {"x": {"head": "a", "end": 12}}) == 10
    assert resumed("x", {"head": "a", "end": 5}, {"x": a}, {"x": {"head": "a", "end": 5}}) == 0
    assert resumed("x.1", {"head": "a", "end": 15}, {"x": a}, {"x": b, "x.1": {"head": "a", "end": 15}}) == 10
    assert resumed("y", {"head": "a", "end": 15}, {"x": a}, {"x": a, "y": {"head": "a", "end": 15}}) == 0


def test_tap_keeps_one_process(spark, tmp_path):
    (tmp_path / "log").mkdir()
    row = lambda **x: json.dumps({"time": "2024-01-02T03:04:05Z", **x}) + "\n"
    lines = [row(msg="tool call", pid=1, tool="read"), row(msg="tool call", pid=2, tool="write"), "broken\n", row(msg="receipt issued", pid=1, receipt_class="impact"), row(msg="started", pid=1), "\n", row(msg="tool call", tool="none")]
    (tmp_path / "log/1.json").write_text("".join(lines))
    told = []
    query = watching.tap_events(watching.tapped(spark, str(tmp_path / "log")), 1, "tap").writeStream.foreachBatch(lambda batch, n: told.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["kind"], r["tool"], r["receipt_class"], r["time"].year) for r in told] == [("tool_call", "read", None, 2024), ("receipt_issued", None, "impact", 2024)]
    # an observation's rows are in the progress of the batch that made them
    seen = [p["observedMetrics"]["tap"] for p in query.recentProgress if "tap" in p["observedMetrics"]]
    assert [sum(x[k] for x in seen) for k in ("events", "foreign", "broken")] == [2, 2, 1]


def test_watched_folder_tells_all_kinds(spark, tmp_path):
    root = tmp_path / "tree"
    for path, text in {"a.py": "x", "sub/b.py": "y", "node_modules/c.js": "z", "sub/d.py": "w"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    look = lambda: sorted((r["path"].rpartition("/")[2], r["kind"], r["hash"] is None) for r in drain(watching.watched(spark, str(root), str(tmp_path / "listings")), tmp_path / "ck"))
    assert look() == [("a.py", "created", False), ("b.py", "created", False), ("d.py", "created", False)]
    (root / "a.py").write_text("xx")
    (root / "sub/b.py").unlink()
    (root / "e.py").write_text("new")
    assert look() == [("a.py", "modified", False), ("b.py", "deleted", True), ("e.py", "created", False)]
    assert look() == []
    (root / "a.py").unlink()
    (root / "sub/b.py").write_text("again")
    assert look() == [("a.py", "deleted", True), ("b.py", "created", False)]
    assert len(list((tmp_path / "listings").glob("*.json"))) <= 3


def test_empty_folders(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert drain(watching.growing_log(spark, str(tmp_path / "log")), tmp_path / "a") == []
    assert drain(watching.watched(spark, str(tmp_path / "log"), str(tmp_path / "listings")).where(F.lit(True)), tmp_path / "b") == []
