"""The tables in the roles that the operators know: graphs, versions, documents, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind, n): items sold to customers of one nation by suppliers of another."""
    items = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("kind"))
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    suppliers = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "src")
    joined = items.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


TRADE = "SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, l_returnflag AS kind, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return trade(spark, d).groupBy("src", "dst").agg(F.sqrt(F.sum("n")).alias("weight"))


WEIGHTED = f"SELECT src, dst, sqrt(sum(n)) AS weight FROM ({TRADE}) GROUP BY ALL"


def nations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("cluster"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """A sparse directed graph among customers: each order points from its customer to one by its key."""
    orders = read(spark, d, "orders")
    return orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7 % 1009 + 1).alias("dst")).distinct()


LINKS = "SELECT DISTINCT o_custkey AS src, o_orderkey * 7 % 1009 + 1 AS dst FROM orders"


def overlay(spark: SparkSession, d: str) -> DataFrame:
    """Changed orders: every fifth, deleted where it was fulfilled, else at a new price; the epoch is its day."""
    orders = read(spark, d, "orders").where("o_orderkey % 5 = 0")
    return orders.select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("live").alias("status"), F.datediff("o_orderdate", F.lit("1992-01-01")).cast("long").alias("write_epoch"))


OVERLAY = "SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'live' END AS status, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS write_epoch FROM orders WHERE o_orderkey % 5 = 0"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


#: Lower-cased words of documents, a row for each.
WORDS = r"SELECT doc_id AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM documents"


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as tool calls of runs."""
    return read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("t"), F.col("event_id").alias("ord"), F.col("event_type").alias("tool"), (F.col("event_type") == "error").alias("is_error"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
