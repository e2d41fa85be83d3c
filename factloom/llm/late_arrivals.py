"""Late rows in a layout of days: a record index finds the days that they touch, and only these are written anew.

A layout keeps of each key the row that arrived last, in files of a fixed number of rows: `day=D/file_no=K` below its folder, the
rows of a day in order of time and key. The record index, bucketed by key, says where each key's row stands and when it arrived. A
late batch is reduced to its winners, which probe the index: those that are beaten by the row that stands go, the others
are tagged with the day and file of the row that they replace. The days of both are dirty. Their files are read again,
replaced rows leave, winners come in, and the days are cut anew; nothing else is written. Places within a day come from a
range sort (`with_places`), so that no task holds a day; a file is one task's work.

What the driver gets: the number of rows, the dirty days and the files (at most rows / rows a file, and one a day).

Null time: day -1, by key. Null key: counts as one key. Null arrival: before all others, and late. Ties of arrival: a row that stands stays;
within one batch the greater time, then the greater of the other columns in their order. Repeated rows: one of them stays. Empty tables: no files.
Extra columns, whatever their names, are not written. A day that loses its last row loses its folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from factloom.operators.places import with_places

from .common import lean, shared_folder, table, tasks, written

#: Stands for a null key, as joins do not.
_NO_KEY = -(1 << 63)


def epoch_day(at: Column) -> Column:
    """Whole days since 1970; null: -1."""
    return F.coalesce(F.unix_date(F.to_date(at)), F.lit(-1)).cast("long")


def epoch_micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a column of times, those without a zone read in UTC whatever the session's zone."""
    c = F.col(name)
    if not isinstance(rows.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM {name})") * 1_000_000).cast("long")


@dataclass(frozen=True)
class DayLayout:
    """A folder of days, its record index beside it, and which of its columns say what a row is of."""

    spark: SparkSession
    folder: str
    schema: StructType
    rows_per_file: int
    key: str = "sale_id"
    at: str = "sold_at"
    arrived: str = "arrived_at"

    @property
    def index_table(self) -> str:
        return "record_index_" + self.folder.rstrip("/").rpartition("/")[2].replace("-", "_")

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def read(self) -> DataFrame:
        """The layout's rows with their day and file_no; there must be a file."""
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("day", LongType()), StructField("file_no", LongType())])).parquet(self.folder)

    def _path(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(conf)

    def files(self) -> dict[tuple[int, int], str]:
        """Each file's path by day and number."""
        root, fs = self._path(self.folder)
        paths = self.read().inputFiles() if fs.exists(root) else []
        return {(int(x), int(y)): unquote(p) for p in paths for x, y in re.findall(r"/day=(-?[0-9]+)/file_no=([0-9]+)/[^/]*$", p)}

    def winners(self, rows: DataFrame) -> DataFrame:
        """Of each key the row that arrived last, by a pre-aggregated maximum, with its key (_key) and day."""
        rest = [c for c in self.columns if c not in (self.key, self.at, self.arrived)]
        best = F.max(F.struct(self.arrived, self.at, *rest))
        keyed = rows.select(*self.columns, F.coalesce(self.key, F.lit(_NO_KEY)).alias("_key")).groupBy("_key").agg(best.alias("_best"))
        own = keyed.select("_key", F.nullif(F.col("_key"), F.lit(_NO_KEY)).alias(self.key), "_best.*")
        return own.select(*self.columns, "_key", epoch_day(F.col(self.at)).alias("day"))

    def write_days(self, rows: DataFrame) -> None:
        """Cut the days of rows (columns, _key, day) and write them; files of these days that are there and have no successor stay."""
        own = rows.select("day", *self.columns, "_key")
        placed = with_places(own, ["day", self.at, "_key"], written, ["day"])
        cut = placed.withColumn("file_no", F.floor(F.col("place") / self.rows_per_file))
        dealt = cut.repartition(tasks(self.spark), "day", "file_no").sortWithinPartitions("day", "file_no", "place")
        dealt.select(*self.columns, "day", "file_no").write.partitionBy("day", "file_no").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.folder)

    def write_index(self) -> None:
        """The record index from the files that stand: (_key, _arrived, _day, _file_no), bucketed by key, in a new folder. One that was there is forgotten."""
        self.drop_index()
        n = tasks(self.spark)
        own = self.read().select(F.coalesce(self.key, F.lit(_NO_KEY)).alias("_key"), F.col(self.arrived).alias("_arrived"), F.col("day").alias("_day"), F.col("file_no").alias("_file_no"))
        own.repartition(n, "_key").write.bucketBy(n, "_key").sortBy("_key").option("path", f"{self.folder.rstrip('/')}-index-{uuid.uuid4().hex}").saveAsTable(self.index_table)

    def start(self, rows: DataFrame) -> None:
        """Write the layout of rows and its record index."""
        self.write_days(self.winners(rows))
        if self.files():
            self.write_index()

    def tagged(self, late: DataFrame) -> DataFrame:
        """The winners of late rows that beat what stands, with the day and file of the row that they replace (_day, _file_no; null: none)."""
        own = self.winners(late)
        if not self.spark.catalog.tableExists(self.index_table):
            return own.withColumns({"_day": F.lit(None).cast("long"), "_file_no": F.lit(None).cast("long")})
        both = own.join(self.spark.table(self.index_table), "_key", "left")
        later = F.col("_day").isNull() | (F.col(self.arrived).isNotNull() & (F.col("_arrived").isNull() | (F.col(self.arrived) > F.col("_arrived"))))
        return both.where(later).drop("_arrived")

    def take_in(self, late: DataFrame) -> list[int]:
        """Make the layout that of all rows, and tell which days were written anew. Before another batch comes, write_index()."""
        tags = written(self.tagged(late), "late-winners")
        dirty = sorted(r["day"] for r in tags.select(F.explode(F.array("day", "_day")).alias("day")).where("day is not null").distinct().collect())
        if not dirty:
            return []
        before, winners = self.files(), tags.select(*self.columns, "_key", "day")
        if before:
            again = self.read().where(F.col("day").isin(dirty)).withColumn("_key", F.coalesce(self.key, F.lit(_NO_KEY)))
            kept = again.join(tags.where("_day is not null").select("_key"), "_key", "left_anti")
            winners = winners.unionByName(kept.select(*self.columns, "_key", "day"))
        self.write_days(winners)
        old, left = set(before.values()), {day: 0 for day in dirty}
        for (day, file_no), path in self.files().items():
            if day in left and path not in old:
                left[day] = max(left[day], file_no + 1)
        for day, file_no in before:  # a dirty day that became shorter leaves files behind
            if day in left and file_no >= left[day]:
                path, fs = self._path(f"{self.folder}/day={day}" + (f"/file_no={file_no}" if left[day] else ""))
                fs.delete(path, True)
        return dirty

    def drop_index(self) -> None:
        """Forget the index's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.index_table}")


def file_digests(layout: DayLayout) -> DataFrame:
    """(day, file_no, n_rows, cents, rows_crc, ids_sha256) of each file, read in file order; a file's ids stream through one task."""
    rows = layout.read()
    micros = lambda c: F.coalesce(epoch_micros(rows, c).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(layout.key).cast("string"), F.lit(""))
    line = F.concat_ws(":", ident, micros(layout.at), micros(layout.arrived))
    own = rows.select("day", "file_no", F.col("_metadata.row_index").alias("nth"), ident.alias("id"), F.coalesce(F.floor(F.col("total") * 100 + 0.5), F.lit(0)).cast("long").alias("cents"), F.crc32(line.cast("binary")).alias("crc"))

    def digest(batches):
        at, held, out = None, None, []

        def closed():
            return (*at, held[0], held[1], held[2], held[3].hexdigest())

        for batch in batches:
            for day, file_no, _, id_, cents, crc in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if (day, file_no) != at:
                    if at is not None:
                        out.append(closed())
                    at, held = (day, file_no), [0, 0, 0, hashlib.sha256()]
                held[3].update((b"," if held[0] else b"") + id_.encode())
                held[0] += 1
                held[1] += cents
                held[2] += crc
        if at is not None:
            out.append(closed())
        names = ["day", "file_no", "n_rows", "cents", "rows_crc", "ids_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string() if k == 5 else pa.int64()) for k in range(6)], names)

    dealt = own.repartition(tasks(layout.spark), "day", "file_no").sortWithinPartitions("day", "file_no", "nth")
    return dealt.mapInArrow(lean(digest), "day long, file_no long, n_rows long, cents long, rows_crc long, ids_sha256 string")


def with_copies(sales: DataFrame) -> DataFrame:
    """Rows whose key's checksum and day say so come again, a little later and with another total."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    again = F.coalesce((h % 3 == 0) & (epoch_day(F.col("sold_at")) % 4 == 0), F.lit(False))
    days = lambda n: F.make_dt_interval(days=n.cast("int"))
    moved = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)}
    row = lambda change: F.struct(*[(change.get(c, F.col(c))).alias(c) for c in sales.columns])
    return sales.select(F.explode(F.when(again, F.array(row({}), row(moved))).otherwise(F.array(row({})))).alias("x")).select("x.*")


CUTOFF = "2024-03-20 00:00:00"


def op12_late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of the early rows, then that of all rows, in a new folder of spark.checkpoint.dir; a row for each final file."""
    own = table(spark, sf_dir, "sales")
    own = own.select("sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority")
    layout = DayLayout(spark, f"{shared_folder(spark)}/sales-days-{uuid.uuid4().hex}", own.schema, 1 + own.count() // 1100)
    rows = with_copies(own)
    early = F.coalesce(F.col("arrived_at") < F.lit(CUTOFF).cast("timestamp_ntz"), F.lit(False))
    try:
        layout.start(rows.where(early))
        dirty = layout.take_in(rows.where(~early))
    finally:
        layout.drop_index()
    files = layout.files()
    if not files:
        return spark.createDataFrame([], "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean")
    names = ",".join(spark.read.option("recursiveFileLookup", True).parquet(layout.folder).columns)  # as the files have them
    anew = set(dirty)
    paths = spark.createDataFrame([(*at, path, at[0] in anew) for at, path in files.items()], "day long, file_no long, path string, rewritten boolean")
    return file_digests(layout).join(paths, ["day", "file_no"]).select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(names).alias("columns"), "ids_sha256", "rewritten")
