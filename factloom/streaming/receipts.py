"""Receipts as the state of a stream: issued, looked up, and gone by age, by number or by a newer version.

State is a map of receipts for each workspace, at most `most` of them, in the RocksDB store, and one timer. Time is
the events' own, behind a watermark, so that a replay gives the same rows however it is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long a receipt holds, in seconds, and how many a workspace keeps.
TTL_SECONDS, MOST = 600, 1000

#: What a row of the stream tells: a receipt is issued, a version came, or a receipt is asked for.
OPS = ("issue", "advance", "lookup")
EVENTS = "workspace string, at timestamp, ord long, op string, receipt string, version long"
OUTCOMES = "workspace string, at timestamp, ord long, receipt string, outcome string"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReceiptStore(StatefulProcessor):
    """Outcomes of one workspace's events, in order of (at, ord).

    A receipt is `issued`; it leaves as `expired` (after its time), `evicted` (the one that was issued first, where a further one is issued and
    `most` are held) or `outdated` (of a version below the one that came). A lookup is a `hit` or a `miss`.
    """

    def __init__(self, ttl_us: int, most: int):
        self.ttl_us, self.most = ttl_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # by place of issue, so that the first one is the first to go
        self.held = handle.getMapState("held", "place long", "receipt string, issued long, ord long, version long")
        self.count = handle.getValueState("count", "place long")

    def _all(self) -> dict[int, tuple]:
        return dict(sorted((int(k[0]), tuple(v)) for k, v in self.held.iterator()))

    def _kept(self, before: set[int], now: dict[int, tuple]) -> None:
        """The state becomes `now`; each access goes through a socket, so receipts that come and leave in one batch are never written."""
        for place in before - now.keys():
            self.held.removeKey((place,))
        for place in now.keys() - before:
            self.held.updateValue((place,), now[place])

    def _left(self, now: dict[int, tuple], gone: list[int], outcome: str, at: int | None, ord_: int | None) -> list[tuple]:
        rows = []
        for place in gone:
            receipt, issued, own, _ = now.pop(place)
            rows.append((issued + self.ttl_us if at is None else at, own if ord_ is None else ord_, receipt, outcome))
        return rows

    def _expired(self, now: dict[int, tuple], at: int) -> list[tuple]:
        return self._left(now, [k for k in sorted(now) if now[k][1] + self.ttl_us < at], "expired", None, None)

    @staticmethod
    def _frame(key: str, rows: list[tuple]) -> pd.DataFrame:
        columns = {"workspace": [key] * len(rows), "at": pd.to_datetime([r[0] for r in rows], unit="us"), "ord": [r[1] for r in rows], "receipt": [r[2] for r in rows], "outcome": [r[3] for r in rows]}
        return pd.DataFrame(columns).astype({"ord": "int64", "workspace": object, "receipt": object, "outcome": object})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.assign(us=frame["at"].astype("datetime64[us]").astype("int64")).sort_values(["us", "ord"], kind="stable")
        now, last = self._all(), self.count.get()[0] if self.count.exists() else 0
        places, before, out = set(now), last, []
        first = min((x[1] for x in now.values()), default=None)  # no receipt was issued before
        for at, ord_, op, receipt, version in zip(frame["us"], frame["ord"], frame["op"], frame["receipt"], frame["version"]):
            at, ord_ = int(at), int(ord_)
            if first is not None and first + self.ttl_us < at:
                out += self._expired(now, at)
                first = min((x[1] for x in now.values()), default=None)
            if op == "issue":
                while len(now) >= self.most:
                    out += self._left(now, [next(iter(now))], "evicted", at, ord_)
                last += 1
                now[last] = (receipt, at, ord_, -1 if pd.isna(version) else int(version))
                first = at if first is None else min(first, at)
                out.append((at, ord_, receipt, "issued"))
            elif op == "advance":
                out += self._left(now, [k for k in sorted(now) if now[k][3] < version], "outdated", at, ord_)
            else:
                out.append((at, ord_, receipt, "hit" if any(x[0] == receipt for x in now.values()) else "miss"))
        if last != before:
            self.count.update((last,))
        self._kept(places, now)
        self._wait(now)
        yield self._frame(key[0], out)

    def _wait(self, now: dict[int, tuple]) -> None:
        """One timer: the first whole millisecond after the last moment of the receipt that was issued first."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now:
            self.handle.registerTimer((min(x[1] for x in now.values()) + self.ttl_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._all()
        places = set(now)
        out = self._expired(now, timerValues.getCurrentWatermarkInMs() * 1000)
        self._kept(places, now)
        self._wait(now)
        yield self._frame(key[0], out)

    def close(self) -> None:
        pass


def receipt_outcomes(events: DataFrame, ttl_seconds: int = TTL_SECONDS, most: int = MOST, lateness: str = "0 seconds") -> DataFrame:
    """(workspace, at, ord, receipt, outcome) of a stream of events (workspace, at, ord, op, receipt, version), none of them without time or workspace.

    The state store of the session must be RocksDB when the query starts (with_rocksdb).
    """
    known = events.where("workspace is not null and at is not null").select("workspace", F.col("at").cast("timestamp").alias("at"), "ord", "op", "receipt", "version")
    grouped = known.withWatermark("at", lateness).groupBy("workspace")
    return grouped.transformWithStateInPandas(statefulProcessor=ReceiptStore(ttl_seconds * 1_000_000, most), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")


class with_rocksdb:
    """The session's state store is RocksDB inside; what it was comes back."""

    _KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.was = self.spark.conf.get(self._KEY, None)
        self.spark.conf.set(self._KEY, ROCKSDB)

    def __exit__(self, *_):
        if self.was is None:
            self.spark.conf.unset(self._KEY)
        else:
            self.spark.conf.set(self._KEY, self.was)


def standing(outcomes: DataFrame) -> DataFrame:
    """(workspace, receipt) of receipts that were issued and have not left."""
    gone = outcomes.where("outcome in ('expired', 'evicted', 'outdated')").select("workspace", "receipt")
    return outcomes.where("outcome = 'issued'").select("workspace", "receipt").join(gone, ["workspace", "receipt"], "left_anti")
