"""Receipts as state against a store in memory, in one batch and in many."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.streaming import receipts

START = datetime(2024, 1, 1)


def outcomes_by_brute_force(events, ttl, most):
    held, out = {}, []
    for w, at, ord_, op, receipt, version in sorted(events, key=lambda e: (e[1], e[2])):
        own = held.setdefault(w, [])
        for r in [r for r in own if r[1] + ttl < at]:
            own.remove(r)
            out.append((w, r[1] + ttl, r[3], r[0], "expired"))
        if op == "issue":
            while len(own) >= most:
                out.append((w, at, ord_, own.pop(0)[0], "evicted"))
            own.append((receipt, at, version, ord_))
            out.append((w, at, ord_, receipt, "issued"))
        elif op == "advance":
            for r in [r for r in own if r[2] < version]:
                own.remove(r)
                out.append((w, at, ord_, r[0], "outdated"))
        else:
            out.append((w, at, ord_, receipt, "hit" if any(r[0] == receipt for r in own) else "miss"))
    end = max(e[1] for e in events)
    for w, own in held.items():
        out += [(w, r[1] + ttl, r[3], r[0], "expired") for r in own if r[1] + ttl + timedelta(milliseconds=1) <= end]
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_receipts_come_and_go(spark, tmp_path, files):
    r, rows, ids = random.Random(files), [], 0
    version = dict.fromkeys("abc", 0)
    for k in range(300):
        w, at = r.choice("abc"), START + timedelta(seconds=7 * k, microseconds=r.randint(0, 999_999))
        op = r.choice(["issue", "issue", "issue", "lookup", "lookup", "advance"] if k % 40 == 0 else ["issue", "lookup"])
        if op == "issue":
            ids += 1
            rows.append((w, at, k, op, f"r{ids}", version[w]))
        elif op == "advance":
            version[w] += 1
            rows.append((w, at, k, op, None, version[w]))
        else:
            rows.append((w, at, k, op, f"r{r.randint(1, max(ids, 1))}", None))
    size = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * size : (n + 1) * size], receipts.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(receipts.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with receipts.with_rocksdb(spark):
        # a watermark of a batch drops what is older, so that rows of later files must not be
        query = receipts.receipt_outcomes(stream, 120, 5, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema(receipts.OUTCOMES).parquet(str(tmp_path / "out"))
    rows_found = sorted((x["workspace"], x["at"], x["ord"], x["receipt"], x["outcome"]) for x in found.collect())
    wanted = outcomes_by_brute_force(rows, timedelta(seconds=120), 5)
    assert rows_found == wanted
    assert {o for *_, o in wanted} == {"issued", "hit", "miss", "expired", "evicted", "outdated"}
    left = {x["receipt"] for x in receipts.standing(found).collect()}
    assert left == {x[3] for x in wanted if x[4] == "issued"} - {x[3] for x in wanted if x[4] in ("expired", "evicted", "outdated")}
    state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # at most five receipts, a count and a timer (in two orders) for each of three workspaces
    assert max(state) <= 3 * 8 and found.where(F.col("outcome") == "issued").count() > 100
