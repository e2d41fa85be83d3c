"""What the corpus operators share: scratch tables, identity of rows, and plain column access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.scratch import few_in_a_batch, give_back, lean, shared_folder, shuffles_dropped, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(documents: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever other columns there are."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def tasks(spark: SparkSession) -> int:
    """Tasks for a stage whose share of work is small: as many as the session's shuffles have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
