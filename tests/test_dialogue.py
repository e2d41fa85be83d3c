"""Dialogue lines of every kind, and calls paired with results in a stream."""

import json

from pyspark.sql import functions as F

from factloom.sources.dialogue import dialogue_events, paired_calls
from factloom.sources.growing import growing_log

LINES = [
    {"type": "system", "subtype": "init", "session_id": "s1", "model": "m", "mcp_servers": [{"name": "x"}, {"name": "y"}]},
    {"type": "system", "subtype": "other"},
    {"type": "system", "subtype": "api_retry"},
    {"type": "stream_event", "event": {"a": 1}},
    {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": [{"type": "text", "text": ""}, {"type": "text", "text": "é" * 200}, {"type": "tool_use", "id": "c1", "name": "read", "input": {"p": [1, {"q": "z"}]}}, {"type": "tool_use", "id": "c2", "name": "grep", "input": {}}]}},
    {"type": "assistant"},
    {"type": "user", "timestamp": "2024-01-01T00:00:05Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": True}, {"type": "text", "text": "t"}, {"type": "tool_result", "tool_use_id": "c9"}]}},
    {"type": "user"},
    {"type": "result", "session_id": "s1", "usage": {"input_tokens": 5, "cache_read_input_tokens": 7}},
    {"type": "result", "session_id": "s2"},
    {"type": "novel"},
    {"no": "type"},
]


def text_lines():
    return [json.dumps(x) for x in LINES] + ['{"type": "assist', "", "[1]"]


def test_events(spark):
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(text_lines())], "file string, at long, line string")
    rows = sorted(dialogue_events(lines).collect(), key=lambda r: (r["at"], r["nth"]))
    assert [(r["at"], r["kind"]) for r in rows] == [(0, "session_init"), (2, "api_retry"), (4, "assistant"), (4, "tool_use"), (4, "tool_use"), (5, "assistant"), (6, "tool_result"), (6, "tool_result"), (8, "result"), (9, "result"), (10, "unknown"), (11, "unknown"), (12, "unknown"), (14, "unknown")]
    assert (rows[0]["session_id"], rows[0]["model"], rows[0]["servers"]) == ("s1", "m", ["x", "y"])
    assert rows[2]["summary"] == "é" * 128 + "..." and rows[5]["summary"] is None
    assert [(r["call_id"], r["tool"], json.loads(r["input"])) for r in rows[3:5]] == [("c1", "read", {"p": [1, {"q": "z"}]}), ("c2", "grep", {})]
    assert [(r["call_id"], r["is_error"]) for r in rows[6:8]] == [("c1", True), ("c9", False)]
    assert rows[8]["usage"].asDict() == {"input_tokens": 5, "output_tokens": 0, "cache_read_tokens": 7, "cache_creation_tokens": 0} and rows[9]["usage"] is None


def test_calls_meet_results_of_later_batches(spark, tmp_path):
    (tmp_path / "log").mkdir()
    call = lambda i, t: {"type": "assistant", "timestamp": f"2024-01-01T{t}Z", "message": {"content": [{"type": "tool_use", "id": i, "name": "n", "input": {}}]}}
    answer = lambda i, t: {"type": "user", "timestamp": f"2024-01-01T{t}Z", "message": {"content": [{"type": "tool_result", "tool_use_id": i}]}}
    batches = [[call("a", "00:00:00"), call("late", "00:00:00"), call("b", "00:01:00")], [answer("a", "00:00:30"), answer("x", "00:02:00")], [answer("b", "00:03:00"), answer("late", "01:30:00"), call("none", "02:00:00")], [call("end", "09:00:00"), answer("y", "09:00:00")], [answer("z", "09:00:01")]]
    rows = []
    for k, batch in enumerate(batches):
        with open(tmp_path / "log/a.json", "a") as file:
            file.writelines(json.dumps(x) + "\n" for x in batch)
        stream = paired_calls(dialogue_events(growing_log(spark, str(tmp_path / "log"))), how="leftOuter")
        stream.writeStream.foreachBatch(lambda b, n: rows.extend(b.select("call_id", F.unix_seconds("answered") - F.unix_seconds("called")).collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r[0], r[1] if r[1] is None else int(r[1])) for r in rows) == [("a", 30), ("b", 120), ("late", None), ("none", None)]
