"""Queries on traces and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import rules, traces
from factloom.sources.rules import as_rules
from factloom.streaming import changes

from .adapters import calls, read
from .registry import query

_CALLS = "SELECT user_id AS run, ts AS t, event_id AS ord, event_type AS tool FROM events"


@query("SELECT event_type AS tool, count(*) AS calls, count_if(event_type = 'error') AS errors, count(DISTINCT user_id) AS runs FROM events GROUP BY 1")
def trace_tool_summary(spark, d):
    return traces.tool_summary(calls(spark, d))


@query("SELECT o_orderpriority AS mode, count(*) AS tasks, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 9) AS success_rate, round(avg(o_totalprice), 4) AS mean_tokens, round(avg(o_custkey), 6) AS mean_duration, round(sum(o_totalprice), 2) AS total_tokens FROM orders GROUP BY ROLLUP (o_orderpriority)")
def mode_aggregates_rollup(spark, d):
    own = read(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("tokens"), F.col("o_custkey").alias("duration"))
    out = traces.report(own)
    return out.select("mode", "tasks", F.round("success_rate", 9).alias("success_rate"), F.round("mean_tokens", 4).alias("mean_tokens"), F.round("mean_duration", 6).alias("mean_duration"), F.round("total_tokens", 2).alias("total_tokens"))


_HITS = "SELECT user_id AS run, event_id % 20 AS item FROM events"
_WANTED = "SELECT DISTINCT c_custkey % 40 AS run, c_nationkey::BIGINT AS item FROM customer WHERE c_mktsegment = 'BUILDING'"


@query(f"WITH c AS ({_HITS}), w AS ({_WANTED}), g AS (SELECT run, count(*) AS n, count(w.item) AS r, count(DISTINCT w.item) AS f FROM c LEFT JOIN w USING (run, item) GROUP BY 1), e AS (SELECT run, count(DISTINCT item) AS x FROM w GROUP BY 1) SELECT run, round(r / nullif(n, 0), 9) AS precision, round(coalesce(f, 0) / nullif(x, 0), 9) AS recall FROM g FULL JOIN e USING (run)")
def precision_recall(spark, d):
    own = read(spark, d, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 20).alias("item"))
    wanted = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 40).alias("run"), F.col("c_nationkey").cast("long").alias("item"))
    return traces.precision_recall(own, wanted, "run").select("run", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""WITH a AS (SELECT p_partkey AS id, p_size > 10 AS passed, p_size % 13 = 0 AS skipped FROM part), b AS (SELECT p_partkey AS id, p_size % 3 <> 0 AS passed, p_size % 17 = 0 AS skipped FROM part WHERE p_partkey % 6 <> 0), c AS (SELECT coalesce(b.passed, FALSE) OR coalesce(b.skipped, FALSE) AS passed FROM a LEFT JOIN b USING (id) WHERE a.passed AND NOT a.skipped)
SELECT count(*) AS tests, count_if(NOT coalesce(passed, FALSE)) AS regressed, round(count_if(NOT coalesce(passed, FALSE)) / nullif(count(*), 0), 9) AS rate FROM c""")
def regression_rate(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    pre = part.select("id", (F.col("p_size") > 10).alias("passed"), (F.col("p_size") % 13 == 0).alias("skipped"))
    post = part.where("id % 6 <> 0").select("id", (F.col("p_size") % 3 != 0).alias("passed"), (F.col("p_size") % 17 == 0).alias("skipped"))
    return traces.regression_rate(pre, post, ["id"]).withColumn("rate", F.round("rate", 9))


@query(f"WITH e AS ({_CALLS}), f AS (SELECT run, min((t, ord)) AS first FROM e WHERE tool = 'view' GROUP BY 1) SELECT run, count_if(first IS NULL OR (t, ord) < first) AS violations FROM e LEFT JOIN f USING (run) WHERE tool = 'purchase' GROUP BY 1")
def forbid_without_prior(spark, d):
    return traces.without_prior(calls(spark, d), "purchase", "view")


@query(f"""WITH e AS ({_CALLS}), a AS (SELECT run, min((t, ord)) AS p FROM e WHERE tool = 'signup' GROUP BY 1), b AS (SELECT run, min((t, ord)) AS p FROM e JOIN a USING (run) WHERE tool = 'click' AND (t, ord) > a.p GROUP BY 1), c AS (SELECT run, min((t, ord)) AS p FROM e JOIN b USING (run) WHERE tool = 'purchase' AND (t, ord) > b.p GROUP BY 1)
SELECT DISTINCT run, 'funnel' AS rule, CASE WHEN c.p IS NULL THEN 0 ELSE 2 END AS score FROM e LEFT JOIN c USING (run) UNION ALL SELECT run, 'no_error', CASE WHEN bool_or(tool = 'error') THEN -1 ELSE 0 END FROM e GROUP BY 1""")
def subsequence_rule(spark, d):
    table = {"expect_sequence": [{"id": "funnel", "score": 2, "pattern": [{"tool": t} for t in ("signup", "click", "purchase")]}], "forbid_set": [{"id": "no_error", "score": -1, "when": {"tool_used": "error"}}]}
    return rules.scored(calls(spark, d).withColumn("arguments", F.lit(None).cast("string")), as_rules(table))


_RULES = {
    "expect_sequence": [{"id": "signup-click", "score": 2, "pattern": [{"tool": "signup"}, {"tool": "click", "args_match": {"k": '"k": 6', "end_regex": "[02468]}"}}]}],
    "forbid_sequence": [{"id": "error-error", "score": -1, "pattern": [{"tool": "error"}, {"tool": "error"}]}],
    "expect_set": [{"id": "all-kinds", "score": 1, "tools": ["view", "click", "signup", "purchase"]}],
    "forbid_set": [{"id": "bought-unseen", "score": -3, "when": {"tool_used": "purchase"}, "require_prior": {"any_of": ["view", "click"]}}],
    "receipts": [{"id": "with-receipt", "score": 4, "when": {"tool_used": "purchase"}, "require": {"receipts_non_empty": True}}],
}
_ARGS = "props || ' receipts:[' || CASE WHEN event_id % 3 = 0 THEN '\"r\"' ELSE ' ' END || ']'"


@query(f"""WITH e AS (SELECT user_id AS run, (ts, event_id) AS pos, event_type AS tool, {_ARGS} AS args FROM events), u AS (SELECT DISTINCT run FROM e), f AS (SELECT run, tool, min(pos) AS pos FROM e GROUP BY ALL),
r AS (SELECT e.run, 'signup-click' AS rule, 2 AS score FROM e JOIN f USING (run) WHERE f.tool = 'signup' AND e.tool = 'click' AND e.pos > f.pos AND contains(args, '"k": 6') AND regexp_matches(args, '[02468]}}')
UNION SELECT run, 'error-error', -1 FROM e WHERE tool = 'error' GROUP BY run HAVING count(*) > 1
UNION SELECT run, 'all-kinds', 1 FROM f WHERE tool IN ('view', 'click', 'signup', 'purchase') GROUP BY run HAVING count(*) = 4
UNION SELECT p.run, 'bought-unseen', -3 FROM f p WHERE p.tool = 'purchase' AND NOT EXISTS (SELECT 1 FROM f q WHERE q.run = p.run AND q.tool IN ('view', 'click') AND q.pos < p.pos)
UNION SELECT e.run, 'with-receipt', 4 FROM e JOIN f USING (run, tool, pos) WHERE tool = 'purchase' AND contains(args, '["r"]'))
SELECT run, rule, coalesce(score, 0)::INT AS score FROM u CROSS JOIN (SELECT unnest(['signup-click', 'error-error', 'all-kinds', 'bought-unseen', 'with-receipt']) AS rule) LEFT JOIN r USING (run, rule)""")
def rules_in_one_pass(spark, d):
    """Sequences with arguments, sets, what must come before and receipts, over all runs at once."""
    own = read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("ts").alias("t"), F.col("event_id").alias("ord"), F.col("event_type").alias("tool"), F.expr(_ARGS).alias("arguments"))
    return rules.scored(own, as_rules(_RULES))


_EVIDENCE = "SELECT l_suppkey AS edge, l_orderkey * 10 + l_linenumber AS citation, l_discount AS contribution, l_quantity > 49 AS partial FROM lineitem"


@query(f"SELECT edge, round(CASE WHEN bool_or(partial) THEN least(sum(contribution), 0.6) ELSE least(sum(contribution), 1.0) END, 6) AS confidence, count(*) AS citations FROM (SELECT * FROM ({_EVIDENCE}) QUALIFY row_number() OVER (PARTITION BY edge ORDER BY contribution DESC, citation) <= 10) GROUP BY 1")
def evidence_confidence(spark, d):
    own = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("edge"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("citation"), F.col("l_discount").alias("contribution"), (F.col("l_quantity") > 49).alias("partial"))
    return traces.evidence_confidence(own).withColumn("confidence", F.round("confidence", 6))


@query("SELECT dimension, round(avg(value), 9) AS mean, avg(value) < 0.7 AS weak FROM (SELECT unnest(['discount', 'tax', 'size']) AS dimension, unnest([l_discount * 10, l_tax * 10, l_quantity / 50]) AS value FROM lineitem) GROUP BY 1")
def rubric_aggregate(spark, d):
    own = read(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_quantity") / 50).alias("size"))
    return traces.rubric(own, ["discount", "tax", "size"]).withColumn("mean", F.round("mean", 9))


_KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'created' ELSE 'modified' END"


def _changes(spark, d):
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return read(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS path, {_KIND} AS kind, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f(path, i, n, "at", kind) AS (SELECT path, i, n, ts, kind FROM e WHERE i = 1 UNION ALL SELECT e.path, e.i, e.n, e.ts, CASE WHEN f.kind IS NULL THEN e.kind WHEN f.kind = 'created' AND e.kind = 'deleted' THEN NULL WHEN f.kind = 'created' THEN 'created' WHEN f.kind = 'deleted' AND e.kind = 'created' THEN 'modified' ELSE e.kind END FROM f JOIN e ON e.path = f.path AND e.i = f.i + 1)
SELECT path, kind, "at" FROM f WHERE i = n AND kind IS NOT NULL""")
def coalesce_events(spark, d):
    return changes.coalesced(_changes(spark, d))


@query("""WITH e AS (SELECT user_id::VARCHAR AS path, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT path, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM g GROUP BY path, s""")
def session_debounce(spark, d):
    return changes.debounced(_changes(spark, d), "1 hour")


@query("SELECT coalesce(a.id, b.id)::BIGINT AS path, CASE WHEN b.id IS NULL THEN 'created' WHEN a.id IS NULL THEN 'deleted' ELSE 'modified' END AS kind FROM (SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 0) a FULL JOIN (SELECT p_partkey AS id FROM part WHERE p_size % 4 <> 0) b ON a.id = b.id")
def change_classification(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_size")
    return changes.classified(part.where("p_size % 3 <> 0"), part.where("p_size % 4 <> 0"))


@query("SELECT CASE WHEN k = 1 THEN user_id * 2 ELSE user_id END AS path, CASE WHEN k = 0 AND (event_type = 'error' OR event_type = 'signup') THEN 'delete' ELSE 'update' END AS action, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR event_type = 'signup' GROUP BY ALL")
def dispatched_actions(spark, d):
    own = read(spark, d, "events").select(F.when(F.col("event_type") == "signup", F.col("user_id") * 2).otherwise(F.col("user_id")).alias("path"), F.col("user_id").alias("old_path"), F.when(F.col("event_type") == "signup", "renamed").when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("kind"))
    return changes.actions(own).groupBy("path", "action").agg(F.count("*").alias("n"))
