"""What a reference resolves to, by which evidence, and what hangs on it.

A ladder of evidence decides each reference alone, so that a whole table resolves in one pass of column
expressions and two equi-joins; chains of accesses and fixpoints repeat such passes a bounded number of times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of evidence, the strongest first, and their confidence.
RUNGS = {"lsp": 1.0, "annotation": 0.9, "constructor": 0.8, "assignment": 0.7, "comment": 0.6, "heuristic": 0.45, "unknown": 0.2}
#: Name endings and the type names that they abbreviate.
ENDINGS = {"Cfg": "Config", "Conf": "Configuration", "Conn": "Connection", "Ctrl": "Controller", "Hdlr": "Handler", "Mgr": "Manager", "Repo": "Repository", "Svc": "Service"}
#: Kinds of edges as users name them, and as they are stored.
SURFACE = {"calls": ["CALLS"], "references": ["REFERENCES", "IMPORTS"], "implements": ["IMPLEMENTS"], "extends": ["EXTENDS"], "has_type": ["RESOLVES_TO"], "uses_type": ["USES_TYPE"], "contains": ["CONTAINS", "DEFINED_IN"], "other": ["OTHER"]}
#: What the tiers of type evidence, the language server and the syntax tree each contribute.
CONTRIBUTIONS = {"tier1": 0.30, "tier2": 0.30, "tier3": 0.25, "tier4": 0.20, "tier5": 0.15, "tier6": 0.10, "tier7": 0.05, "lsp": 0.4, "ast": 0.3}
CRITICAL, REFUTED, COMMENT_CAP, CHAIN_DEPTH, FIXPOINT_ROUNDS = 0.8, 0.2, 0.6, 8, 8


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def package_of(symbol) -> Column:
    """What stands before the last colon of a symbol's key; empty without one."""
    return F.regexp_extract(_col(symbol), "^(.*):", 1)


def exported(symbol) -> Column:
    """Whether the last colon-separated part begins with an upper-case ASCII letter."""
    return F.substring_index(_col(symbol), ":", -1).rlike("^[A-Z]")


def stored_kinds(surface: list[str]) -> list[str]:
    return [kind for name in surface for kind in SURFACE.get(name, [])]


def _annotation(text: Column) -> Column:
    open_ = ~text.contains(":=") & (~text.contains("=") | text.startswith("var "))
    return F.when(open_, F.regexp_extract(text, r"\w+\s+\*?([A-Za-z_]\w*)\s*$", 1))


def _assignment(text: Column) -> Column:
    plain = ~text.startswith("var ") & ~text.contains(":=") & ~text.contains("(")
    return F.when(plain, F.regexp_extract(text, r"\w+\s*=\s*(\w+)\s*$", 1))


def _shape(name: Column) -> Column:
    found = F.lit(None).cast("string")
    for short, long in reversed(ENDINGS.items()):
        stem = name.substr(F.lit(1), F.length(name) - len(short))
        found = F.when(name.endswith(short) & (F.length(name) > len(short)), F.concat(F.upper(stem.substr(1, 1)), stem.substr(F.lit(2), F.length(stem)), F.lit(long))).otherwise(found)
    return found


def type_signals(signature, comment, name) -> Column:
    """(evidence, type_name) of the strongest textual signal, or null."""
    text = F.trim(F.coalesce(_col(signature), F.lit("")))
    tiers = [
        ("annotation", _annotation(text)),
        ("constructor", F.regexp_extract(text, r"(?:^|[^A-Za-z0-9_])New(\w+)\s*\(", 1)),
        ("assignment", _assignment(text)),
        ("comment", F.regexp_extract(F.coalesce(_col(comment), F.lit("")), r"(?i)\breturns\b(?:\s+(?:the|an|a))?\s+\*?(\w+)", 1)),
        ("heuristic", _shape(F.coalesce(_col(name), F.lit("")))),
    ]
    return F.coalesce(*[F.when(F.coalesce(found, F.lit("")) != "", F.struct(F.lit(tier).alias("evidence"), found.alias("type_name"))) for tier, found in tiers])


#: Patterns of the type named by an annotation, a construction, an assignment and a comment, by language.
SIGNALS = {
    "python": {
        "annotation": (r"->\s*([A-Za-z_][A-Za-z0-9_]*)", r"\b[a-zA-Z_]\w*\s*:\s*([A-Za-z_][A-Za-z0-9_]*)"),
        "constructor": (r"=\s*([A-Z][A-Za-z0-9_]*)\s*\(",),
        "assignment": (r"\b\w+\s*=\s*([a-z_][A-Za-z0-9_]*)\s*$",),
        "comment": (r"#\s*type\s*:\s*([A-Za-z_][A-Za-z0-9_]*)",),
    },
    "typescript": {
        "annotation": (r"\w+\s*:\s*([A-Za-z_][A-Za-z0-9_]*)",),
        "constructor": (r"\bnew\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",),
        "assignment": (r"\b\w+\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*$",),
        "comment": (r"@type\s*\{([A-Za-z_][A-Za-z0-9_]*)\}", r"@returns?\s*\{([A-Za-z_][A-Za-z0-9_]*)\}", r"@param\s*\{([A-Za-z_][A-Za-z0-9_]*)\}"),
    },
}
#: Languages that are resolved as another one.
RESOLVED_AS = {"javascript": "typescript"}


def language_signals(language: str, signature, comment, name) -> Column:
    """(evidence, type_name) of the strongest signal by the rules of one language, or null; Go has rules of its own form."""
    if language == "go":
        return type_signals(signature, comment, name)
    texts, tiers = {"comment": F.coalesce(_col(comment), F.lit(""))}, []
    for tier, patterns in SIGNALS[language].items():
        text = texts.get(tier, F.trim(F.coalesce(_col(signature), F.lit(""))))
        tiers.append((tier, F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])))
    tiers.append(("heuristic", _shape(F.coalesce(_col(name), F.lit("")))))
    return F.coalesce(*[F.when(F.coalesce(found, F.lit("")) != "", F.struct(F.lit(tier).alias("evidence"), found.alias("type_name"))) for tier, found in tiers])


def dispatched_signals(language, signature, comment, name) -> Column:
    """The signals by each row's language; null where no rules are for it."""
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in RESOLVED_AS.items() for x in pair]), _col(language)), _col(language))
    found = F.when(own == "go", language_signals("go", signature, comment, name))
    for name_ in SIGNALS:
        found = found.when(own == name_, language_signals(name_, signature, comment, name))
    return found


#: What one enrichment may ask for: symbols a file, references a symbol and a file, steps of a hierarchy.
MOST_SYMBOLS, MOST_REFERENCES, MOST_FILE_REFERENCES, MOST_STEPS = 200, 1000, 5000, 2


def within_budgets(found: DataFrame, symbols: int = MOST_SYMBOLS, references: int = MOST_REFERENCES, total: int = MOST_FILE_REFERENCES, steps: int = MOST_STEPS) -> DataFrame:
    """Rows (file, symbol, reference, step) that an enrichment keeps: the first symbols of a file, references of each and of the file."""
    order = lambda *by: Window.partitionBy(*by)
    near = found.where(F.col("step") <= steps)
    marked = near.withColumn("_s", F.dense_rank().over(order("file").orderBy("symbol"))).withColumn("_r", F.row_number().over(order("file", "symbol").orderBy("reference"))).where((F.col("_s") <= symbols) & (F.col("_r") <= references))
    return marked.withColumn("_t", F.row_number().over(order("file").orderBy("symbol", "reference"))).where(F.col("_t") <= total).drop("_s", "_r", "_t")


def edge_weight(base, source, validation, confidence) -> Column:
    """A kind's base weight by how it was found, whether it was validated and how sure it is."""
    return _col(base) * _col(source) * _col(validation) * _col(confidence)


def confidence_of(evidence) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in RUNGS.items() for x in pair]), _col(evidence))


def resolve(refs: DataFrame, firm: DataFrame, types: DataFrame) -> DataFrame:
    """(ref_id, resolved, target, confidence, evidence, state) for refs (ref_id, file, signature, comment, name).

    `firm` holds (src, dst) of validated edges of full confidence, `types` (type_name, type_id, type_file), where
    the smallest id of a name counts. A type of another directory stays unresolved, with at most a comment's
    confidence; a reference without any signal is returned as unknown.
    """
    edge = firm.groupBy(F.col("src").alias("ref_id")).agg(F.min("dst").alias("firm_target"))
    named = types.groupBy("type_name").agg(F.min(F.struct("type_id", "type_file")).alias("t"))
    own = refs.join(edge, "ref_id", "left").withColumn("s", F.when(F.col("firm_target").isNull(), type_signals("signature", "comment", "name")))
    own = own.withColumn("type_name", F.col("s.type_name")).join(named, "type_name", "left")
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    away = F.coalesce(folder(F.col("t.type_file")) != folder(F.col("file")), F.lit(False))
    evidence = F.when(F.col("firm_target").isNotNull(), "lsp").otherwise(F.coalesce("s.evidence", F.lit("unknown")))
    out = own.select("ref_id", F.coalesce("firm_target", "t.type_id").alias("target"), evidence.alias("evidence"), away.alias("away"))
    raw = confidence_of("evidence")
    resolved = (F.col("evidence") != "unknown") & ~F.col("away")
    return out.select("ref_id", resolved.alias("resolved"), "target", F.when(F.col("away"), F.least(raw, F.lit(COMMENT_CAP))).otherwise(raw).alias("confidence"), "evidence", F.when(resolved, "validated").otherwise("unresolved").alias("state"))


def walk_chains(requests: DataFrame, hops: DataFrame, depth: int = CHAIN_DEPTH) -> DataFrame:
    """(req_id, resolved, target, confidence, reason) of requests (req_id, ref_id, length).

    Each token of a chain resolves what the one before resolved to, by hops (ref_id, resolved, target,
    confidence). The first hop that fails answers; so does a chain that is empty or longer than `depth`.
    """
    hop = hops.select(F.col("ref_id").alias("at"), F.col("resolved").alias("_r"), F.col("target").alias("_t"), F.col("confidence").alias("_c"))
    fit = F.col("length").between(1, depth)
    now = requests.select("req_id", "length", F.col("ref_id").alias("at"), fit.alias("resolved"), F.lit(None).cast("long").alias("target"), F.lit(RUNGS["unknown"]).alias("confidence"), F.when(F.col("length") == 0, "empty chain").when(F.col("length") > depth, "chain too deep").alias("reason"))
    for k in range(1, depth + 1):
        live = F.col("resolved") & (F.col("length") >= k)
        step = now.withColumn("at", F.when(live, F.col("at"))).join(hop, "at", "left")
        ok = F.coalesce("_r", F.lit(False))
        now = step.select("req_id", "length", F.when(live & ok, F.col("_t")).alias("at"), F.when(live, ok).otherwise(F.col("resolved")).alias("resolved"), F.when(live, F.col("_t")).otherwise(F.col("target")).alias("target"), F.when(live, F.coalesce("_c", F.lit(RUNGS["unknown"]))).otherwise(F.col("confidence")).alias("confidence"), "reason")
    return now.select("req_id", "resolved", "target", "confidence", "reason")


def fixpoint(pending: DataFrame, step: Callable[[DataFrame], DataFrame], cut, rounds: int = FIXPOINT_ROUNDS) -> DataFrame:
    """Repeat `step`, which returns all its rows with those it can resolve resolved, until none changes; at most `rounds` times."""
    now, left = cut(pending, "fixpoint"), None
    for _ in range(rounds):
        now = cut(step(now), "fixpoint")
        open_ = now.where("not resolved").count()
        if open_ in (0, left):
            break
        left = open_
    return now


def assigned_types(variables: DataFrame, flows: DataFrame, cut, rounds: int = FIXPOINT_ROUNDS) -> DataFrame:
    """(id, resolved, type) after types flow along assignments (src to dst), the smallest type where several arrive."""

    def step(now):
        known = now.where("resolved").select(F.col("id").alias("src"), F.col("type").alias("_new"))
        into = flows.join(known, "src").groupBy(F.col("dst").alias("id")).agg(F.min("_new").alias("_new"))
        return now.join(into, "id", "left").select("id", (F.col("resolved") | F.col("_new").isNotNull()).alias("resolved"), F.when(F.col("resolved"), F.col("type")).otherwise(F.col("_new")).alias("type"))

    return fixpoint(variables, step, cut, rounds)


def emitted(refs: DataFrame, responses: DataFrame) -> DataFrame:
    """Edges of resolved references; a comment never says more than its cap, and what is unresolved is marked so."""
    capped = F.when(F.col("evidence") == "comment", F.least("confidence", F.lit(COMMENT_CAP))).otherwise(F.col("confidence"))
    source = F.when(F.col("evidence") == "lsp", "lsp.unknown").when(F.col("evidence") == "comment", "comment.unknown").otherwise(F.col("evidence"))
    both = responses.join(refs.select("ref_id", "kind"), "ref_id")
    return both.select(F.col("ref_id").alias("src"), F.col("target").alias("dst"), "kind", source.alias("source"), capped.alias("confidence"), F.lit(1.0).alias("weight"), F.when(F.col("resolved"), F.col("state")).otherwise("unresolved").alias("state"))


def critical_impacts(edges: DataFrame) -> DataFrame:
    """(impact, critical) of edges (impact, confidence, src, dst): unsure, or reaching an exported symbol of another package."""
    crosses = (package_of("src") != package_of("dst")) & exported("dst")
    return edges.groupBy("impact").agg(F.bool_or((F.col("confidence") < CRITICAL) | F.coalesce(crosses, F.lit(False))).alias("critical"))


def with_verdicts(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(impact, confidence, refuted): any refuted edge of an impact decides, then any confirmed one, else it is as it was."""
    met = edges.join(verdicts.select("src", "dst", "kind", "confirmed"), ["src", "dst", "kind"], "left").groupBy("impact")
    seen = met.agg(F.max("confidence").alias("before"), F.coalesce(F.bool_or(~F.col("confirmed")), F.lit(False)).alias("refuted"), F.coalesce(F.bool_or("confirmed"), F.lit(False)).alias("sure"))
    return seen.select("impact", F.when(F.col("refuted"), F.lit(REFUTED)).when(F.col("sure"), F.lit(1.0)).otherwise(F.col("before")).alias("confidence"), "refuted")


def seeds(wanted: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """(path, name, resolution, candidates): exact, ambiguous with the first keys, or not_found."""
    met = wanted.select("path", "name").distinct().join(symbols.select("path", "name", "stable_key"), ["path", "name"], "left")
    place = F.row_number().over(Window.partitionBy("path", "name").orderBy("stable_key"))
    first = met.withColumn("n", place).where(F.col("n") <= most + 1).groupBy("path", "name").agg(F.sort_array(F.collect_list("stable_key")).alias("c"))
    state = F.when(F.size("c") == 0, "not_found").when(F.size("c") == 1, "exact").otherwise("ambiguous")
    return first.select("path", "name", state.alias("resolution"), F.slice("c", 1, most).alias("candidates"))
