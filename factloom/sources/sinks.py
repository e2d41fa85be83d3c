"""Where results go: score and cluster tables by version, notes by key, reports and drawings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.retrieval import postings, postings_after
from factloom.plans.scratch import written


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class VersionedTable:
    """Rows that are replaced a partition at a time: scores by (score_name, graph_version), clusters by (projection, graph_version)."""

    def __init__(self, spark: SparkSession, path: str, partition: list[str], **options: str):
        self.spark, self.path, self.partition, self.options = spark, path, partition, options

    def upsert(self, rows: DataFrame) -> None:
        """Replaces the partitions that the rows are of, and no others."""
        rows.write.options(**self.options).partitionBy(*self.partition).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path) if _exists(self.spark, self.path) else None

    def delete(self, **values) -> None:
        """Drops one partition's folder; its rows are not rewritten."""
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        folder = "/".join(f"{c}={escaped(str(values[c]))}" for c in self.partition)
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def marked_stale(scores: DataFrame) -> DataFrame:
    return scores.withColumn("status", F.lit("stale"))


def latest_version_at_most(rows: DataFrame, by: str, wanted: int) -> DataFrame:
    """Rows of the greatest version not above the wanted one, for each group; the fallback where the wanted one is missing."""
    best = rows.where(F.col("graph_version") <= wanted).groupBy(by).agg(F.max("graph_version").alias("graph_version"))
    return rows.join(best, [by, "graph_version"], "left_semi")


def cache_misses(seen: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (path, modified) that the cache does not hold as they are; only these are extracted again."""
    return seen.join(cached.select("path", "modified").distinct(), ["path", "modified"], "left_anti")


def flattened_symbols(trees: DataFrame, depth: int = 8) -> DataFrame:
    """(file, name, qualified, level) of nested symbols given as rows (file, id, parent, name); a root has a null parent.

    Levels are joined one by one; symbols below `depth` are an error rather than lost.
    """
    level = trees.where("parent is null").select("file", "id", "name", F.col("name").alias("qualified"), F.lit(0).alias("level"))
    out, below = level, trees.where("parent is not null").select("file", F.col("id").alias("_id"), F.col("parent").alias("id"), F.col("name").alias("_name"))
    for k in range(1, depth + 1):
        step = level.select("file", "id", "qualified").join(below, ["file", "id"])
        level = step.select("file", F.col("_id").alias("id"), F.col("_name").alias("name"), F.concat_ws(".", "qualified", "_name").alias("qualified"), F.lit(k).alias("level"))
        out = out.union(level)
    if not level.isEmpty() and not level.join(below, ["file", "id"], "left_semi").isEmpty():
        raise ValueError(f"symbols are nested deeper than {depth} levels")
    return out.drop("id")


def notes_after(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Notes (name, content) after edits (name, ordinal, op, content, new_name) in order: save, rename or delete; the last edit of a name counts.

    A rename keeps the content that the note had before the batch; what it would overwrite goes.
    """
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ordinal")))
    last = edits.withColumn("_n", place).where("_n = 1").select("name", "op", F.col("content").alias("_content"), "new_name")
    both = notes.join(last, "name", "full_outer").where("op is null or op <> 'delete'")
    moved = both.select(F.when(F.col("op") == "rename", F.col("new_name")).otherwise(F.col("name")).alias("name"), F.when(F.col("op") == "save", F.col("_content")).otherwise(F.col("content")).alias("content"), (F.col("op") == "rename").alias("_moved"))
    best = moved.where("content is not null").groupBy("name").agg(F.max(F.struct(F.coalesce("_moved", F.lit(False)).alias("m"), "content")).alias("x"))
    return best.select("name", "x.content")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """What a folder holds, by its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def compacted_files(spark: SparkSession, source: str, target: str, file_bytes: int = 256 << 20) -> int:
    """The same rows in files of about so many bytes, and how many these are; the reader switches to the target once it is whole."""
    files = max(1, -(-stored_bytes(spark, source) // file_bytes))
    spark.read.parquet(source).repartition(files).write.mode("overwrite").parquet(target)
    return files


def vacuumed(spark: SparkSession, source: str, target: str, last_ms: int | None, now_ms: int, interval_ms: int, file_bytes: int = 256 << 20) -> bool:
    """Compacts a folder where its last time, if any, is an interval ago or more, and tells whether it did."""
    due = last_ms is None or now_ms - last_ms >= interval_ms
    if due:
        compacted_files(spark, source, target, file_bytes)
    return due


class PostingStore:
    """A text index on Parquet in buckets by document; a batch rewrites the buckets that it touches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets, self.table = spark, buckets, VersionedTable(spark, path, ["bucket"])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame | None:
        found = self.table.read()
        return None if found is None else found.select("id", "term", "tf")

    def upsert(self, docs: DataFrame, gone: DataFrame | None = None) -> None:
        """Documents (id, text) replace their postings, gone ones (id) lose theirs."""
        held = self.table.read()
        if held is None:
            self.rebuild(docs)
            return
        ids = docs.select("id") if gone is None else docs.select("id").union(gone.select("id"))
        touched = self._bucketed(ids).select("bucket").distinct()
        after = postings_after(held.join(F.broadcast(touched), "bucket", "left_semi").select("id", "term", "tf"), docs, gone)
        # A bucket that loses all its documents would not be overwritten: its folder holds one row that says nothing.
        empty = touched.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"), "bucket")
        self.table.upsert(written(self._bucketed(after).unionByName(empty), "postings"))

    def rebuild(self, docs: DataFrame) -> None:
        self.table.upsert(self._bucketed(postings(docs)))

    def postings(self) -> DataFrame:
        return self.read().where("id is not null")


def written_json(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A small report as a Markdown table; more than `most` rows are an error."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows belongs in a file")
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    head = ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows]) + "\n"


def dot(edges: DataFrame, most: int = 5000) -> str:
    """A small graph (src, dst) in the DOT language, sorted; more than `most` edges are an error."""
    rows = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).distinct().orderBy("src", "dst").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a drawing of more than {most} edges cannot be read")
    return "digraph {\n" + "".join(f"  {json.dumps(r['src'])} -> {json.dumps(r['dst'])};\n" for r in rows) + "}\n"
