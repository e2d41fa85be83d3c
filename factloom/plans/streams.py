"""Queries that run as streams: tables written as logs, folders and event files, drained to the end.

Each call takes a new folder in the shared one and leaves it there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.dialogue import dialogue_events, paired_calls
from factloom.sources.growing import growing_log
from factloom.streaming import receipts, watching

from .adapters import read
from .registry import query
from .scratch import shared_folder


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(stream: DataFrame, root: str, name: str) -> DataFrame:
    """All that a stream has now, appended to a table of files below root, and that table."""
    stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/{name}")


_MESSAGE = "CASE event_type WHEN 'purchase' THEN 'receipt issued' WHEN 'signup' THEN 'started' ELSE 'tool call' END"


@query("SELECT event_id::VARCHAR AS trace_id, CASE WHEN event_type = 'purchase' THEN 'receipt_issued' ELSE 'tool_call' END AS kind, event_type AS tool, user_id % 3 AS pid, ts AS time FROM events WHERE event_type <> 'signup' AND user_id % 3 = 1")
def tapped_events(spark, d):
    """Events as logs of three processes, torn by lines that are no JSON; half of the logs come after the first drain."""
    root = _folder(spark)
    row = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.expr(_MESSAGE).alias("msg"), F.col("event_type").alias("tool"), (F.col("user_id") % 3).alias("pid"), F.col("event_id").cast("string").alias("trace_id"))
    lines = read(spark, d, "events").select("event_id", F.concat(F.to_json(row), F.when(F.col("event_id") % 7 == 0, "\n{torn").otherwise("")).alias("value"))
    for half in (0, 1):
        lines.where(F.col("event_id") % 2 == half).select("value").write.mode("append").text(f"{root}/log")
        found = _run(watching.tap_events(watching.tapped(spark, f"{root}/log"), 1), root, "events")
    return found.select("trace_id", "kind", "tool", "pid", F.col("time").cast("timestamp_ntz").alias("time"))


@query("""WITH b AS (SELECT DISTINCT p_brand AS brand FROM part), c AS (SELECT brand, unnest(CASE WHEN brand LIKE '%1' THEN ['created', 'deleted', 'created'] ELSE ['created'] END) AS kind FROM b)
SELECT brand, kind, count(*) AS n FROM c GROUP BY ALL""")
def watched_changes(spark, d):
    """A table of files by brand is watched while some of its brands are written anew: their old files go and others come."""
    root = _folder(spark)
    part = read(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_partkey", "p_size")
    write = lambda rows: rows.repartition("brand").write.partitionBy("brand").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/tree")
    write(part)
    _run(watching.watched(spark, f"{root}/tree", f"{root}/listings"), root, "changes")
    write(part.where("brand like '%1'").withColumn("p_size", F.col("p_size") + 1))
    found = _run(watching.watched(spark, f"{root}/tree", f"{root}/listings"), root, "changes")
    brand = F.url_decode(F.regexp_extract("path", "/brand=([^/]*)/[^/]*$", 1))
    return found.select(brand.alias("brand"), "kind").groupBy("brand", "kind").agg(F.count("*").alias("n"))


_TTL, _KEPT = 259_200, 3


@query(f"""WITH e AS (SELECT user_id AS w, event_id, event_type AS k, ts, count_if(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events),
i AS (SELECT *, lead(ts, {_KEPT}) OVER (PARTITION BY w ORDER BY ts, event_id) AS pushed, lead(event_id, {_KEPT}) OVER (PARTITION BY w ORDER BY ts, event_id) AS pushed_id FROM e WHERE k IN ('purchase', 'click')),
a AS (SELECT w, version - 1 AS version, ts AS came, event_id AS came_id FROM e WHERE k = 'signup'),
g AS (SELECT i.*, came, came_id, ts + INTERVAL {_TTL} SECOND AS over FROM i LEFT JOIN a USING (w, version)),
o AS (SELECT w, event_id, CASE WHEN (came IS NULL OR over < came) AND (pushed IS NULL OR over < pushed) THEN CASE WHEN epoch_us(over) // 1000 + 1 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) THEN 'expired' END WHEN pushed IS NULL OR (came IS NOT NULL AND (came, came_id) < (pushed, pushed_id)) THEN 'outdated' ELSE 'evicted' END AS outcome FROM g)
SELECT w AS workspace, event_id AS receipt, outcome FROM o""")
def receipt_stream(spark, d):
    """Events as receipts: purchases and clicks issue one, a signup brings a new version. What each receipt came to; null: it still stands."""
    root = _folder(spark)
    version = F.expr("count_if(event_type = 'signup') over (partition by user_id order by ts, event_id)")
    op = F.expr("case event_type when 'signup' then 'advance' when 'purchase' then 'issue' when 'click' then 'issue' else 'lookup' end")
    events = read(spark, d, "events").select(F.col("user_id").cast("string").alias("workspace"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), op.alias("op"), F.col("event_id").cast("string").alias("receipt"), version.alias("version"))
    events.write.parquet(f"{root}/in")
    with receipts.with_rocksdb(spark):
        # one batch: files are not in order of time, and a watermark would drop the rows of later ones
        stream = spark.readStream.schema(receipts.EVENTS).parquet(f"{root}/in")
        outcomes = _run(receipts.receipt_outcomes(stream, _TTL, _KEPT), root, "outcomes")
    own = outcomes.groupBy("workspace", "receipt").agg(F.max(F.when(F.col("outcome").isin("expired", "evicted", "outdated"), F.col("outcome"))).alias("outcome"), F.bool_or(F.col("outcome") == "issued").alias("issued"))
    # a removal's receipt is the one that left; lookups ask for what was never issued
    return own.where("issued").select(F.col("workspace").cast("long").alias("workspace"), F.col("receipt").cast("long").alias("receipt"), "outcome")


@query("""SELECT a.conv_id, a.turn, CASE WHEN a.turn % 4 = 1 THEN 'search' ELSE 'read' END AS tool, length(a.text)::BIGINT AS n, (b.conv_id % 5 = 0) AS is_error, 60::BIGINT AS seconds
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'assistant' AND b.role = 'user'""")
def dialogue_calls(spark, d):
    """Conversations as nested stream-JSON: an assistant's turn makes a call, the user's next turn brings its result; half of the lines come later."""
    root = _folder(spark)
    turns = read(spark, d, "conversations")
    when = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ident = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    tool = F.when(F.col("turn") % 4 == 1, "search").otherwise("read")
    call = F.struct(F.lit("tool_use").alias("type"), ident(F.col("turn")).alias("id"), tool.alias("name"), F.struct(F.length("text").alias("n")).alias("input"))
    said = F.to_json(F.struct(F.lit("assistant").alias("type"), when.alias("timestamp"), F.struct(F.array(call).alias("content")).alias("message")))
    result = F.struct(F.lit("tool_result").alias("type"), ident(F.col("turn") - 1).alias("tool_use_id"), (F.col("conv_id") % 5 == 0).alias("is_error"))
    told = F.to_json(F.struct(F.lit("user").alias("type"), when.alias("timestamp"), F.struct(F.array(result).alias("content")).alias("message")))
    other = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("api_retry").alias("subtype")))
    lines = turns.select("turn", F.when(F.col("role") == "assistant", said).when(F.col("role") == "user", told).otherwise(other).alias("value"))
    for half in (0, 1):
        lines.where(F.col("turn") % 2 == half).select("value").write.mode("append").text(f"{root}/log")
        events = dialogue_events(growing_log(spark, f"{root}/log")).withColumn("file", F.lit("all"))  # a conversation's lines lie in several files
        found = _run(paired_calls(events), root, "pairs")
    part = lambda k: F.split("call_id", "-")[k].cast("long")
    return found.select(part(0).alias("conv_id"), part(1).alias("turn"), "tool", F.get_json_object("input", "$.n").cast("long").alias("n"), "is_error", (F.unix_seconds("answered") - F.unix_seconds("called")).alias("seconds"))
