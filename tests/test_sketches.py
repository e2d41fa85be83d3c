"""What a write sees on its way: rows and sketches of distinct values, kept for each snapshot and united on reading."""

import pytest
from pyspark.sql import functions as F

from factloom.sources.snapshots import SnapshotStore

SF = "/root/testdata/sf0.01"
COLUMNS = {"orders": "o_orderkey", "customer": "c_name", "lineitem": "l_partkey", "part": "p_brand", "documents": "text", "events": "ts", "clicks": "client_id"}


@pytest.mark.parametrize("name", COLUMNS)
def test_distinct_values_of_all_snapshots(spark, tmp_path, name):
    store, rows, column = SnapshotStore(spark, str(tmp_path / "store")), spark.read.parquet(f"{SF}/{name}.parquet"), COLUMNS[name]
    halves = [rows.where(F.pmod(F.xxhash64(column), F.lit(3)) != k) for k in (0, 1)]
    told = []
    for half in halves:
        snapshot = store.begin()
        told.append(store.write(snapshot, name, half, (column,))["rows"])
        store.commit(snapshot)
    pending = store.begin()
    store.write(pending, name, spark.range(10**5).select(F.col("id").cast("string").alias(column)), (column,))
    exact = lambda x: x.where(F.col(column).isNotNull()).select(column).distinct().count()
    assert told == [h.count() for h in halves]
    both = {r["column"]: r["n"] for r in store.distinct(name).collect()}
    assert both[column] == pytest.approx(exact(halves[0].union(halves[1])), rel=0.02, abs=0.5)
    assert store.distinct(name, [1]).first()["n"] == pytest.approx(exact(halves[0]), rel=0.02, abs=0.5)


def test_a_write_reads_its_rows_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    snapshot = store.begin()
    assert store.write(snapshot, "facts", spark.range(1000, numPartitions=4).mapInArrow(count, "id long"), ("id",)) == {"rows": 1000}
    store.commit(snapshot)
    assert seen.value == 1000 and store.read("facts").count() == 1000 and store.summary("facts").first()["rows"] == 1000
    again = store.begin()
    assert store.write(again, "facts", spark.range(0)) == {"rows": 0}
