"""Repairs of a graph as transactions: each batch changes the edges and their version once, however often it is handed over."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEDGER = "batch string, version long, folder string, removed long, upserted long, at timestamp"


class RepairedGraph:
    """Edges (src, dst, kind) of a graph below a folder. One writer, many readers.

    A row of the ledger is a commit: it names the batch, the version and the folder of that version's edges, which was written before. The
    row is one file that appears whole, so that version, edges and batch come together or not at all; a batch that has a row is passed over, and what a
    broken one wrote is in no row. Readers take the folder of the highest version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def ledger(self) -> DataFrame:
        """All commits; their number is that of the batches."""
        jvm, path = self.spark.sparkContext._jvm, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ledger")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path) if jvm else False
        return self.spark.read.schema(_LEDGER).parquet(f"{self.root}/ledger") if there else self.spark.createDataFrame([], _LEDGER)

    def _last(self):
        return self.ledger().orderBy(F.desc("version"), F.desc("at")).first()

    def version(self) -> int:
        last = self._last()
        return last["version"] if last else 0

    def edges(self) -> DataFrame:
        """(src, dst, kind) of the last commit."""
        last = self._last()
        if last is None:
            raise ValueError("the graph has no commit yet")
        return self.spark.read.parquet(f"{self.root}/{last['folder']}")

    def _commit(self, batch: str, version: int, folder: str, removed: int, upserted: int) -> None:
        row = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.lit(removed).cast("long").alias("removed"), F.lit(upserted).cast("long").alias("upserted"), F.current_timestamp().alias("at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def start(self, edges: DataFrame) -> None:
        """The first commit; a graph that has one stays as it is."""
        if self._last() is None:
            folder = f"edges/{uuid.uuid4().hex}"
            edges.select("src", "dst", "kind").distinct().write.parquet(f"{self.root}/{folder}")
            self._commit("", 1, folder, 0, 0)

    def apply(self, batch: str, removed: DataFrame, upserted: DataFrame) -> tuple[int, bool]:
        """(version, whether this call changed it): nodes (id) go with their edges, edges (src, dst, kind) come or replace their equals.

        An empty repair and one that was committed before change nothing; the first leaves a row all the same, so that its batch is known.
        """
        if self.ledger().where(F.col("batch") == batch).limit(1).count():
            return self.version(), False
        last, now = self._last(), self.edges()
        gone, fresh = removed.select("id").where("id is not null").distinct(), upserted.select("src", "dst", "kind").distinct()
        n, m = gone.count(), fresh.count()
        if not n and not m:
            self._commit(batch, last["version"], last["folder"], 0, 0)
            return last["version"], False
        at = lambda rows, end: rows.join(gone.withColumnRenamed("id", end), end, "left_anti")
        after = at(at(now.join(fresh, ["src", "dst", "kind"], "left_anti").unionByName(fresh), "src"), "dst").select("src", "dst", "kind")
        folder = f"edges/{uuid.uuid4().hex}"
        after.write.parquet(f"{self.root}/{folder}")
        self._commit(batch, last["version"] + 1, folder, n, m)
        return last["version"] + 1, True

    def follow(self, repairs: DataFrame, checkpoint: str, stream: str = "repairs") -> None:
        """Apply a stream of repairs (op: remove or upsert, id, src, dst, kind), each micro-batch as one transaction, and return when it is drained.

        A batch is known by the stream's name and its number, so that one which a restart hands over again is not applied twice.
        """

        def apply(rows: DataFrame, number: int) -> None:
            rows = rows.persist()
            try:
                self.apply(f"{stream}-{number}", rows.where("op = 'remove'").select("id"), rows.where("op = 'upsert'").select("src", "dst", "kind"))
            finally:
                rows.unpersist()

        repairs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
