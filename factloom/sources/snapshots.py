"""Versioned fact tables on plain Parquet: data first, the manifest row last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factloom.operators.versioned import latest_committed

_MANIFEST = "snapshot_id long, status string, created_at timestamp"
_SUMMARY = "name string, column string, rows long, sketch binary"
#: A sketch has 2 to the power of so many registers: an error of 0.8 %.
SKETCH_BITS = 14


class SnapshotStore:
    """One writer, many readers; readers see only what a manifest row says is committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        """The last status of each snapshot."""
        if not self._there(f"{self.root}/manifest"):  # no snapshot has been begun yet
            return self.spark.createDataFrame([], _MANIFEST)
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")
        return rows.groupBy("snapshot_id").agg(F.max(F.struct("created_at", "status")).alias("x")).select("snapshot_id", "x.status", "x.created_at")

    def _mark(self, snapshot: int, status: str) -> None:
        row = self.spark.range(1).select(F.lit(snapshot).cast("long").alias("snapshot_id"), F.lit(status).alias("status"), F.current_timestamp().alias("created_at"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def begin(self) -> int:
        snapshot = (self.manifest().agg(F.coalesce(F.max("snapshot_id"), F.lit(0))).first()[0] or 0) + 1
        self._mark(snapshot, "pending")
        return snapshot

    def write(self, snapshot: int, name: str, facts: DataFrame, sketched: tuple[str, ...] = ()) -> dict:
        """Writes a snapshot's facts, and what the pass that wrote them saw: their number and, of the columns `sketched`, sketches of their distinct values.

        Both are kept beside the facts (`summary`, `distinct`), so that neither has to be counted again. Returns {rows}.
        """
        self._require(snapshot, "pending")
        seen = Observation()
        parts = [F.hll_sketch_agg(F.xxhash64(c), SKETCH_BITS).alias(f"s{k}") for k, c in enumerate(sketched)]
        facts.observe(seen, F.count(F.lit(1)).alias("rows"), *parts).write.mode("overwrite").parquet(f"{self.root}/{name}/snapshot_id={snapshot}")
        told = seen.get
        rows = [(name, c, told["rows"], bytearray(told[f"s{k}"])) for k, c in enumerate(sketched)] or [(name, None, told["rows"], None)]
        self.spark.createDataFrame(rows, _SUMMARY).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}/summary/of={snapshot}")
        return {"rows": told["rows"]}

    def summary(self, name: str) -> DataFrame:
        """(of, name, column, rows, sketch) of a table's committed snapshots: a row for each, or for each sketched column."""
        kept = self.spark.read.schema(f"{_SUMMARY}, of long").parquet(f"{self.root}/{name}/summary")
        committed = self.manifest().where("status = 'committed'").select(F.col("snapshot_id").alias("of"))
        return kept.join(F.broadcast(committed), "of", "left_semi")  # a row a snapshot

    def distinct(self, name: str, snapshots: list[int] | None = None) -> DataFrame:
        """(column, n): about how many distinct values (an error of some 1 %) the sketched columns have over the snapshots, all committed ones if none are given; no fact is read."""
        own = self.summary(name).where("column is not null")
        own = own if snapshots is None else own.where(F.col("of").isin(snapshots))
        return own.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", False)).alias("n"))

    def _require(self, snapshot: int, status: str) -> None:
        row = self.manifest().where(F.col("snapshot_id") == snapshot).first()
        if row is None or row["status"] != status:
            raise ValueError(f"snapshot {snapshot} is {row['status'] if row else 'unknown'}, not {status}")

    def commit(self, snapshot: int) -> None:
        self._require(snapshot, "pending")
        self._mark(snapshot, "committed")

    def abort(self, snapshot: int) -> None:
        self._require(snapshot, "pending")
        self._mark(snapshot, "aborted")

    def latest(self) -> int:
        return latest_committed(self.manifest()).first()[0]

    def read(self, name: str, snapshot: int | None = None) -> DataFrame:
        snapshot = self.latest() if snapshot is None else snapshot
        self._require(snapshot, "committed")
        return self.spark.read.parquet(f"{self.root}/{name}/snapshot_id={snapshot}")

    def next(self, counter: str) -> int:
        """A monotone counter's next value: of the graph's version, the overlay's epoch. One writer."""
        path = f"{self.root}/counters/{counter}"
        value = (self._values(path) or 0) + 1
        self.spark.range(1).select(F.lit(value).cast("long").alias("value")).coalesce(1).write.mode("append").parquet(path)
        return value

    def current(self, counter: str) -> int:
        return self._values(f"{self.root}/counters/{counter}") or 0

    def _values(self, path: str) -> int | None:
        return self.spark.read.schema("value long").parquet(path).agg(F.max("value")).first()[0] if self._there(path) else None

    def _there(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def retain(self, keep: int) -> list[int]:
        """Keeps the newest committed snapshots; the others' folders go, after their manifest rows say so."""
        rows = self.manifest().where("status = 'committed'").orderBy(F.desc("snapshot_id")).collect()
        gone = [r["snapshot_id"] for r in rows[keep:]]
        jvm = self.spark.sparkContext._jvm
        for snapshot in gone:
            self._mark(snapshot, "dropped")
            for folder in self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jvm.org.apache.hadoop.fs.Path(self.root)):
                target = jvm.org.apache.hadoop.fs.Path(folder.getPath(), f"snapshot_id={snapshot}")
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return gone

    def compact(self, name: str, overlay: DataFrame, key: list[str], keep: int = 5, most_rows: int | None = None) -> tuple[int, DataFrame]:
        """(snapshot, rest): a new snapshot of the effective view of the latest one and an overlay, and what the overlay still holds.

        The overlay's epoch is read first, and only rows up to it are taken in, so that whatever is written meanwhile
        stays. An overlay of over `most_rows` is an error before anything begins; a failed write aborts the snapshot.
        """
        from factloom.operators.versioned import cleared, effective, newest_per_key

        epoch = overlay.agg(F.coalesce(F.max("write_epoch"), F.lit(0))).first()[0]
        taken = newest_per_key(overlay.where(F.col("write_epoch") <= epoch), key)
        if most_rows is not None and taken.limit(most_rows + 1).count() > most_rows:
            raise ValueError(f"the overlay has over {most_rows} rows")
        base, snapshot = self.read(name), self.begin()
        try:
            self.write(snapshot, name, effective(base, taken, key))
        except Exception:
            self.abort(snapshot)
            raise
        self.commit(snapshot)
        self.retain(keep)
        return snapshot, cleared(overlay, epoch)
