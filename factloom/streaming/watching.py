"""Streams of files and traces, and what a driver does about them: drain, wait, run once."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.files import skipped
from factloom.sources.growing import BLOCK, folder_changes, growing_log

def watched(spark: SparkSession, root: str, listings: str) -> DataFrame:
    """(path, kind, length, modified, hash) of what came, changed or went below a folder since the last batch; skipped folders are left out.

    `listings` is a folder of the stream's own, outside of root, for what it saw last.
    """
    return folder_changes(spark, root, listings).where(~skipped("path"))


#: The messages of a log that are events, and what they are.
LOGGED = {"tool call": "tool_call", "receipt issued": "receipt_issued"}
_LOGGED = "time timestamp, msg string, tool string, outcome string, duration_ms long, pid long, trace_id string, receipt_class string"


def tapped(spark: SparkSession, folder: str, schema: str = _LOGGED, block: int = BLOCK) -> DataFrame:
    """Lines of a folder's growing logs, each once: their fields, `_broken` (the line, where it is no JSON), `file` and `at`, its first byte."""
    kept = F.from_json("line", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return growing_log(spark, folder, block).where("trim(line) <> ''").select(kept.alias("x"), "file", "at").select("x.*", "file", "at")


def tap_events(lines: DataFrame, pid: int, counts: str | None = None) -> DataFrame:
    """Calls and receipts of one process among a tap's lines, with their kind.

    Under the name `counts`, where given, each batch reports what it took and left: events, foreign (of another process) and broken lines.
    """
    kind = F.coalesce(*[F.when(F.col("msg") == m, F.lit(k)) for m, k in LOGGED.items()])
    marked = lines.withColumn("kind", kind).withColumn("_own", F.coalesce(F.col("pid") == pid, F.lit(False)))
    if counts:
        known = F.col("kind").isNotNull()
        marked = marked.observe(counts, F.count_if(known & F.col("_own")).alias("events"), F.count_if(known & ~F.col("_own")).alias("foreign"), F.count_if(F.col("_broken").isNotNull()).alias("broken"))
    return marked.where("kind is not null and _own").drop("_broken", "_own", "msg")


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all that has come, and nothing later, to sink(batch, number); the checkpoint folder remembers what was handed over."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def waited(ready: Callable[[], dict[str, bool]], seconds: float, pause: float = 0.05) -> tuple[bool, dict[str, bool]]:
    """(all ready, what is ready): asks until every part is ready or the time is over, then tells what it has."""
    until = time.monotonic() + seconds
    while True:
        state = ready()
        if all(state.values()) or time.monotonic() >= until:
            return all(state.values()), state
        time.sleep(min(pause, max(0.0, until - time.monotonic())))


class SingleFlight:
    """Runs a job once for all callers that ask for its key while it runs; each gets its result or its error."""

    def __init__(self):
        self._lock, self._running = threading.Lock(), {}

    def run(self, key, job: Callable[[], object]):
        with self._lock:
            held = self._running.get(key)
            first = held is None
            if first:
                held = self._running[key] = {"done": threading.Event()}
        if first:
            try:
                held["value"] = job()
            except Exception as error:
                held["error"] = error
            finally:
                with self._lock:
                    del self._running[key]
                held["done"].set()
        held["done"].wait()
        if "error" in held:
            raise held["error"]
        return held["value"]
