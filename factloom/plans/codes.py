"""Queries on identities, signatures, indents, messages, reports and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import codes, scalars
from factloom.operators import resolve, retrieval, traces
from factloom.sources import files
from factloom.streaming import changes

from .adapters import read
from .registry import query


@query("""SELECT c_custkey, printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT)), lambda s, b: (xor(s, b) * 1099511628211) % 18446744073709551616::HUGEINT)::UBIGINT) AS fnv, sha256(c_name)[1:32] AS note, sha256(c_name || chr(0) || c_mktsegment)[1:16] AS task FROM customer""")
def name_hashes(spark, d):
    return read(spark, d, "customer").select("c_custkey", codes.fnv1a("c_name").alias("fnv"), codes.note_hash("c_name").alias("note"), codes.task_hash("c_name", "c_mktsegment").alias("task"))


_LINES = "string_split('  ' || replace(coalesce(text, ''), '. ', '.' || chr(10) || '    '), chr(10))"


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents), b AS (SELECT doc_id, l, list_filter(l, lambda x: NOT regexp_matches(x, '^[ \\t]*$')) AS w FROM l),
m AS (SELECT doc_id, l, w, coalesce(list_min(list_transform(w, lambda x: length(regexp_extract(x, '^( *)', 1)))), 0) AS n FROM b)
SELECT doc_id, repeat(' ', n::INT) AS margin, array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^[ \\t]*$') THEN '' ELSE x[n + 1:] END), chr(10)) AS dedented FROM m WHERE NOT list_bool_or(list_transform(w, lambda x: regexp_matches(x, '^ *\\t')))""".replace("list_bool_or(", "list_contains(").replace("'^ *\\t')))", "'^ *\\t')), true)"))
def dedented_lines(spark, d):
    text = F.concat(F.lit("  "), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n    ")))
    own = read(spark, d, "documents").select("doc_id", F.split(text, "\n", -1).alias("l"))
    own = own.where(~F.exists("l", lambda x: x.rlike("^ *\t") & ~x.rlike("^[ \t]*$")))
    return own.select("doc_id", codes.common_margin("l").alias("margin"), F.array_join(codes.dedented("l", codes.common_margin("l")), "\n").alias("dedented"))


@query("SELECT p_partkey, '      a ' || p_name || chr(10) || chr(10) || '        b ' || p_brand AS text FROM part")
def reflowed_edit(spark, d):
    own = read(spark, d, "part").select("p_partkey", F.split(F.concat(F.lit("  a "), "p_name", F.lit("\n \t\n    b "), "p_brand"), "\n", -1).alias("new"))
    searched, found = F.array(F.lit("  x"), F.lit(""), F.lit("    y")), F.array(F.lit("\t"), F.lit("      x"), F.lit("        y"))
    return own.select("p_partkey", F.array_join(codes.reflowed("new", searched, found), "\n").alias("text"))


@query("""SELECT page_id, starts_with(url, 'http://a_b/') AS topic, regexp_replace(url, '^http://', '') AS path, CASE WHEN contains(regexp_replace(url, '^[a-z]+://', ''), '/') THEN regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^(.*)/[^/]*$', 1) ELSE '.' END AS package,
CASE page_id % 4 WHEN 0 THEN 'textDocument/references' WHEN 1 THEN 'plain' WHEN 2 THEN '' ELSE 'a.b' END AS method FROM pages""")
def code_paths(spark, d):
    source = F.get(F.array(*[F.lit(x) for x in ("lsp.go.textDocument/references", "lsp.plain", "comment.x", "lsp.py.a.b")]), (F.col("page_id") % 4).cast("int"))
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return read(spark, d, "pages").select("page_id", codes.under_topic("url", "http://a_b").alias("topic"), codes.path_of_uri(F.regexp_replace("url", "^http://", "file://")).alias("path"), codes.package_of_path(path).alias("package"), codes.method_of_source(source).alias("method"))


@query("""SELECT event_id, '{"source":"' || CASE WHEN event_id % 2 = 0 THEN 'semantic' ELSE 'fallback' END || '"' || CASE WHEN event_id % 2 = 1 THEN ',"fallback_reason":"stale"' ELSE '' END || CASE WHEN event_id % 3 <> 0 THEN ',"graph_version":' || event_id % 3 ELSE '' END || ',"tool":"' || event_type || '","user":' || user_id || '}' AS answer, epoch_us(ts) // 1000 AS millis, props LIKE '%1%' AND regexp_matches(props, '[0-9]{2}') AS args, event_id % 4 = 1 AS receipts FROM events""")
def answers(spark, d):
    odd, version = F.col("event_id") % 2 == 1, F.col("event_id") % 3
    answer = codes.envelope(F.when(odd, "fallback").otherwise("semantic"), {"tool": F.col("event_type"), "source": F.lit("shadowed"), "user": F.col("user_id")}, F.when(odd, "stale").otherwise(""), version)
    args = F.get(F.array(*[F.lit(x) for x in ('{receipts:[ ]}', '{receipts:["r1"]}', "{}", "{receipts:[")]), (F.col("event_id") % 4).cast("int"))
    return read(spark, d, "events").select("event_id", answer.alias("answer"), codes.epoch_millis("ts").alias("millis"), codes.argument_match("props", ["1"], ["[0-9]{2}"]).alias("args"), codes.holds_receipts(args).alias("receipts"))


@query("SELECT c_custkey, 'calls:' || c_nationkey || ':' || c_custkey AS token, 'calls' AS projection, c_nationkey::BIGINT AS graph_version, c_custkey AS cluster_id, TRUE AS bad_is_null FROM customer")
def cluster_tokens(spark, d):
    token = scalars.cluster_token(F.lit("calls"), "c_nationkey", "c_custkey")
    parts, bad = scalars.cluster_token_parts(token), scalars.cluster_token_parts(F.concat(token, F.lit("x")))
    return read(spark, d, "customer").select("c_custkey", token.alias("token"), parts["projection"].alias("projection"), parts["graph_version"].alias("graph_version"), parts["cluster_id"].alias("cluster_id"), bad.isNull().alias("bad_is_null"))


@query("SELECT o_orderpriority AS mode, o_orderstatus AS tool, sum(o_custkey % 7 + 1)::BIGINT AS n FROM orders GROUP BY ALL UNION ALL SELECT o_orderpriority, 'read', sum(2) FROM orders GROUP BY ALL")
def mode_tool_totals(spark, d):
    tools = F.create_map(F.col("o_orderstatus"), F.col("o_custkey") % 7 + 1, F.lit("read"), F.lit(2).cast("long"))
    results = read(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), tools.alias("tools"))
    return traces.tool_maps(results).select("mode", F.explode("tools").alias("tool", "n"))


@query("SELECT o_orderpriority AS mode, sum(o_custkey % 3)::BIGINT AS warned, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS blocked, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 ELSE 0 END)::BIGINT AS receipts_issued FROM orders GROUP BY 1")
def safety_totals(spark, d):
    own = read(spark, d, "orders").select(F.col("o_orderpriority").alias("mode"), (F.col("o_custkey") % 3).alias("warned"), (F.col("o_orderstatus") == "F").cast("int").alias("blocked"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5).alias("receipts_issued"))
    return traces.safety_totals(own)


@query("SELECT event_type AS tool, le, count_if(CASE WHEN le IS NULL THEN TRUE ELSE coalesce(value, 1e300) <= le END) AS n FROM events, (SELECT unnest([1.0, 5.0, 25.0, 100.0, NULL])::DOUBLE AS le) GROUP BY ALL")
def duration_histograms(spark, d):
    return traces.histograms(read(spark, d, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("duration")), [1.0, 5.0, 25.0, 100.0])


_SIGNATURES = (("python", "def f(a) -> Widget:", None), ("python", "x = Ring(1)", None), ("python", "y = other", None), ("python", "y", "# type: Gear"), ("javascript", "let a = new Cog(2)", None), ("typescript", "let b: Bolt", None), ("typescript", "c", "@returns {Nut} it"), ("go", "func New() x", "Returns the Lid"), ("cobol", "x: Y", None))
_FOUND = (("annotation", "Widget"), ("constructor", "Ring"), ("assignment", "other"), ("comment", "Gear"), ("constructor", "Cog"), ("annotation", "Bolt"), ("comment", "Nut"), ("comment", "Lid"), (None, None))


@query("SELECT p_partkey, f.e AS evidence, f.t AS type_name FROM part JOIN (SELECT * FROM (VALUES " + ", ".join(f"({k}, {repr(e) if e else 'NULL'}, {repr(t) if t else 'NULL'})" for k, (e, t) in enumerate(_FOUND)) + ") AS v(k, e, t)) f ON f.k = p_partkey % 9")
def language_signals(spark, d):
    at = lambda j: F.get(F.array(*[F.lit(x[j]).cast("string") for x in _SIGNATURES]), (F.col("p_partkey") % 9).cast("int"))
    found = resolve.dispatched_signals(at(0), at(1), at(2), F.lit(""))
    return read(spark, d, "part").select("p_partkey", found["evidence"].alias("evidence"), found["type_name"].alias("type_name"))


@query("""WITH r AS (SELECT l_suppkey AS file, l_partkey AS symbol, l_orderkey * 10 + l_linenumber AS reference, l_linenumber AS step FROM lineitem WHERE l_linenumber <= 2), a AS (SELECT *, dense_rank() OVER (PARTITION BY file ORDER BY symbol) AS s, row_number() OVER (PARTITION BY file, symbol ORDER BY reference) AS n FROM r)
SELECT file, symbol, reference, step FROM a WHERE s <= 20 AND n <= 2 QUALIFY row_number() OVER (PARTITION BY file ORDER BY symbol, reference) <= 15""")
def enrichment_budgets(spark, d):
    own = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("reference"), F.col("l_linenumber").alias("step"))
    return resolve.within_budgets(own, 20, 2, 15, 2)


_RENAMES = "SELECT CASE WHEN event_type = 'signup' THEN (user_id + 1) || '→' || user_id ELSE user_id::VARCHAR END AS key, CASE event_type WHEN 'signup' THEN 'renamed' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'created' ELSE 'modified' END AS kind, ts, event_id FROM events"


@query(f"""WITH RECURSIVE e AS (SELECT key, kind, ts, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY key) AS n FROM ({_RENAMES})),
f(key, i, n, "at", kind) AS (SELECT key, i, n, ts, kind FROM e WHERE i = 1 UNION ALL SELECT e.key, e.i, e.n, e.ts, CASE WHEN f.kind IS NULL THEN e.kind WHEN f.kind = 'created' AND e.kind = 'deleted' THEN NULL WHEN f.kind = 'created' THEN 'created' WHEN f.kind = 'deleted' AND e.kind = 'created' THEN 'modified' WHEN f.kind = 'renamed' AND e.kind = 'modified' THEN 'renamed' ELSE e.kind END FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1)
SELECT key, kind, "at" FROM f WHERE i = n AND kind IS NOT NULL""")
def coalesced_renames(spark, d):
    kind = F.when(F.col("event_type") == "signup", "renamed").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "created").otherwise("modified")
    own = read(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), (F.col("user_id") + 1).cast("string").alias("old_path"), kind.alias("kind"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    return changes.coalesced(changes.change_key(own), "key").orderBy("key")


@query("SELECT NULL AS path, 'bulk_update' AS kind, string_agg(DISTINCT p, ',' ORDER BY p) AS paths FROM (SELECT c_name AS p FROM customer)")
def bulk_update(spark, d):
    batch = read(spark, d, "customer").select(F.col("c_name").alias("path"), F.lit("modified").alias("kind"))
    return changes.bulk_collapsed(batch, 50).select("path", "kind", F.array_join("paths", ",").alias("paths"))


@query("SELECT p_partkey AS id, 'func ' || replace(p_name, ' ', '') || '[T0 any, T1 any](a T0, K2 T1) T0' AS signature, sha256('func ' || replace(p_name, ' ', '') || '[T0 any, T1 any](a T0, K2 T1) T0')[1:16] AS hash FROM part")
def canonical_signatures(spark, d):
    key = F.when(F.col("p_partkey") % 2 == 0, "K").otherwise("Elem")
    text = F.concat(F.lit("func  "), F.replace("p_name", F.lit(" "), F.lit("")), F.lit("["), key, F.lit(" any, V any](a "), key, F.lit(",\n\tK2 V) "), key, F.lit(" { return a }"))
    return codes.signature_hashes(read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("signature")))


@query("SELECT p_partkey AS path, 'import x' || chr(10) || 'class A:' || chr(10) || '    def f(self):' || chr(10) || '        ...' || chr(10) || 'y = ' || p_size AS text FROM part")
def elided_bodies(spark, d):
    text = F.concat(F.lit("import x\nclass A:\n    def f(self):\n        z = "), F.col("p_partkey").cast("string"), F.lit("\n        return z\ny = "), F.col("p_size").cast("string"))
    return retrieval.elided_files(read(spark, d, "part").select(F.col("p_partkey").alias("path"), text.alias("text")), 2)


#: A file for each of five languages, and the definitions and relations in it: name, qualified name, line; relation, of, to.
_SOURCES = (
    ("a.go", 'package a\nimport "fmt"\nfunc (s *Store) Put(k string) {\n}\n', (("Put", "Store.Put", 3),), (("imports", "", "fmt"),)),
    ("b.py", "import os\nclass A(B):\n    def m(self):\n        pass\n", (("A", "A", 2), ("m", "A.m", 3)), (("imports", "", "os"), ("inherits", "A", "B"))),
    ("c.ts", 'import {x} from "./x";\nclass P extends Q {\n  speak(a: string) {\n  }\n}\n', (("P", "P", 2), ("speak", "P.speak", 3)), (("imports", "", "./x"), ("inherits", "P", "Q"))),
    ("d.lua", "function run(a)\nend\n", (("run", "run", 1),), ()),
    ("e.sh", "deploy() {\n  x\n}\n", (("deploy", "deploy", 1),), ()),
)


def _sources(spark, d):
    pick = lambda k: F.get(F.array(*[F.lit(x[k]) for x in _SOURCES]), (F.col("p_partkey") % 5).cast("int"))
    return read(spark, d, "part").select(F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), pick(0)).alias("path"), pick(1).alias("content"))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + ")"


@query(f"SELECT 'src/' || p_partkey || f AS file, name, qualified, line FROM part JOIN {_values((k, x[0], *t) for k, x in enumerate(_SOURCES) for t in x[2])} AS v(k, f, name, qualified, line) ON k = p_partkey % 5")
def extracted_definitions(spark, d):
    return files.tags(_sources(spark, d)).where("kind = 'def'").select("file", "name", "qualified", "line")


@query(f"SELECT 'src/' || p_partkey || f AS file, relation, of, \"to\" FROM part JOIN {_values((k, x[0], *t) for k, x in enumerate(_SOURCES) for t in x[3])} AS v(k, f, relation, of, \"to\") ON k = p_partkey % 5")
def extracted_relations(spark, d):
    return files.structure(_sources(spark, d)).select("file", "relation", F.coalesce("of", F.lit("")).alias("of"), "to")
