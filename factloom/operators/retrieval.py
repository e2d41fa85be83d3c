"""Text search, rank fusion, budgets, line matching, intervals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60.0


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf): lower-cased words and how often each is in a document."""
    words = F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))
    return docs.select("id", words.alias("term")).where("term <> ''").groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _sizes_and_hits(index: DataFrame, keys: list[str], terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """(*keys, size) and (*keys, term, tf) of postings (*keys, term, tf) or of texts (*keys, text), whose words are counted within their rows."""
    if "term" in index.columns:
        return index.groupBy(*keys).agg(F.sum("tf").alias("size")), index.where(F.col("term").isin(sorted(set(terms))))
    own = index.select(*keys, F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "").alias("words"))
    asked = F.explode(F.filter("words", lambda w: w.isin(sorted(set(terms)))))
    hits = own.select(*keys, asked.alias("term")).where("term <> ''").groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    return own.groupBy(*keys).agg(F.sum(F.size("words")).alias("size")).where("size > 0"), hits


def bm25(index: DataFrame, terms: list[str], top: int, digits: int | None = None) -> DataFrame:
    """(id, score): the best documents for a query's terms, by scores of so many digits, from postings (id, term, tf) or texts (id, text).

    Past the sizes only the terms' postings are read; of texts, no other word leaves its row.
    """
    size, hits = _sizes_and_hits(index, ["id"], terms)
    whole = size.agg(F.count("*").cast("double").alias("n"), F.avg("size").alias("mean"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "term").join(size, "id").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    score = F.sum(part) if digits is None else F.round(F.sum(part), digits)
    return scored.groupBy("id").agg(score.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def field_texts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, text) of several text columns, null ones as empty."""
    return docs.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields])).alias("x")).select("id", "x.field", "x.text")


def field_postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, term, tf) of several text columns, null ones as empty."""
    long = field_texts(docs, fields)
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    return long.select("id", "field", words.alias("term")).where("term <> ''").groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def match_any(index: DataFrame, terms: list[str], top: int, anchors: list | None = None, boost: float = 1.0, digits: int = 6) -> DataFrame:
    """(id, score): the best documents for any of the terms in any field, from postings (id, field, term, tf) or texts (id, field, text); each field is scored by its own statistics. Anchors that match a term gain a boost; one that matches none is no hit."""
    size, hits = _sizes_and_hits(index, ["field", "id"], terms)
    whole = size.groupBy("field").agg(F.count("*").cast("double").alias("n"), F.avg("size").alias("mean"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), ["field", "term"]).join(size, ["field", "id"]).join(F.broadcast(whole), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    rows = scored.select("id", part.alias("part"))
    if anchors:
        rows = rows.union(hits.where(F.col("id").isin(anchors)).select("id").distinct().select("id", F.lit(boost)))
    return rows.groupBy("id").agg(F.round(F.sum("part"), digits).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def postings_after(index: DataFrame, docs: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Postings after a batch: those of its documents are made anew, those of gone ones (id) leave."""
    out = docs.select("id") if gone is None else docs.select("id").union(gone.select("id"))
    return index.join(out.distinct(), "id", "left_anti").unionByName(postings(docs))


def ranks(scored: DataFrame, score: str = "score", most: int = 10_000) -> DataFrame:
    """(id, rank): one-based places of a short list, an id counting at its best place alone; a list of over `most` is an error."""
    best = scored.groupBy("id").agg(F.max(score).alias("score")).orderBy(F.desc("score"), "id").limit(most + 1)
    placed = best.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
    return placed.select("id", F.when(F.col("rank") <= most, F.col("rank")).otherwise(F.raise_error(F.lit(f"a ranked list has over {most} rows"))).cast("int").alias("rank"))


def fuse(first: DataFrame, second: DataFrame, weights=(1.0, 1.0), k: float = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (id, rank); ids of either list stay, rank 0 where absent."""
    both = first.select("id", F.col("rank").alias("a")).join(second.select("id", F.col("rank").alias("b")), "id", "full_outer")
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.select("id", (part("a", weights[0]) + part("b", weights[1])).alias("score"), F.coalesce("a", F.lit(0)).alias("first_rank"), F.coalesce("b", F.lit(0)).alias("second_rank"))


def fuse_additive(contributions: DataFrame, k: float = RRF_K) -> DataFrame:
    """(path, score) of many ranked members (path, rank) each: all of them add."""
    return contributions.groupBy("path").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def boosted(scored: DataFrame, clusters: DataFrame, seed, factor: float = 1.25) -> DataFrame:
    """Scores, raised where a row is of the seed's cluster, the smallest if it has several: one row is broadcast."""
    own = clusters.where(F.col("id") == seed).agg(F.min("cluster").alias("_own"))
    out = scored.join(clusters.select("id", "cluster"), "id", "left").join(F.broadcast(own))
    return out.select(*[F.when(F.col("cluster") == F.col("_own"), F.col("score") * factor).otherwise(F.col("score")).alias("score") if c == "score" else F.col(c) for c in scored.columns])


def packed(items: DataFrame, budget: int, by: str, order: str, cost: str) -> DataFrame:
    """Greedy packing within each group: an item over what is left is passed over, later ones may fit.

    A group is one request's ranked candidates, which a top-k has bounded before.
    """
    listed = items.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda s, x: F.when(s["used"] + x["c"] <= budget, F.struct((s["used"] + x["c"]).alias("used"), F.concat(s["taken"], F.array(x["o"].cast("long"))).alias("taken"))).otherwise(s)
    return listed.select(by, F.aggregate("x", start, step).alias("r")).select(by, F.explode("r.taken").alias(order))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("id", F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))


def grep(docs: DataFrame, pattern: str, context: int = 1, text: str = "text") -> DataFrame:
    """(id, n, line, before, after): lines that match, with those about them; per document, without a shuffle."""
    listed = docs.select("id", F.split(text, "\n", -1).alias("l")).select("id", "l", F.posexplode("l").alias("n", "line")).where(F.col("line").rlike(pattern))
    return listed.select("id", (F.col("n") + 1).alias("n"), "line", F.expr(f"slice(l, greatest(n + 1 - {context}, 1), least(n, {context}))").alias("before"), F.expr(f"slice(l, n + 2, {context})").alias("after"))


def suggestions(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion): a vocabulary entry that contains the word or is in it, else the nearest within `most` edits; the first at ties.

    The vocabulary is a list of names that fits a broadcast; its size is checked.
    """
    if vocabulary.limit(10_001).count() > 10_000:
        raise ValueError("suggestions compare against a small vocabulary of at most 10,000 names")
    pairs = words.select("word").distinct().crossJoin(F.broadcast(vocabulary.select("name").distinct()))
    within = F.col("name").contains(F.col("word")) | F.col("word").contains(F.col("name"))
    scored = pairs.select("word", "name", F.when(within, 0).otherwise(1).alias("kind"), F.when(within, 0).otherwise(F.levenshtein("word", "name")).alias("d")).where((F.col("kind") == 0) | (F.col("d") <= most))
    return scored.groupBy("word").agg(F.min(F.struct("kind", "d", "name"))["name"].alias("suggestion"))


def innermost(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """For each point (key, point_id, at) the shortest interval (key, interval_id, low, high) that holds it, the smaller id at ties.

    An interval's level is the power of two above its length; at its level it touches two bands at most, and a point
    looks into one band of each level (at most 64) that there is. So the join is an equi-join, and what meets is near.
    """
    spans = intervals.where("low <= high").select(key, "interval_id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    spans = spans.withColumn("level", F.length(F.bin(F.col("high") - F.col("low"))))
    band = lambda c: F.expr(f"shiftright({c}, level)")
    spans = spans.withColumn("band", F.explode(F.sequence(band("low"), band("high"))))
    asked = points.select(key, "point_id", F.col("at").cast("long").alias("at")).join(F.broadcast(spans.select("level").distinct()))
    held = asked.withColumn("band", band("at")).join(spans, [key, "level", "band"]).where("at >= low and at <= high")
    best = F.min(F.struct((F.col("high") - F.col("low")).cast("int").alias("size"), "interval_id"))
    return held.groupBy("point_id").agg(best["interval_id"].alias("interval_id"), best["size"].alias("size"))


def nearest_window(docs: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """(id, n, equal): the one-based first line of the window with most lines equal to the wanted ones, the earliest at ties.

    A text with fewer lines is one window from line 1. Per document, without a shuffle.
    """
    goal = F.array(*[F.lit(x) for x in wanted])
    count = lambda i: F.size(F.filter(F.zip_with(F.slice("l", i, len(wanted)), goal, lambda a, b: a.eqNullSafe(b)), lambda x: x))
    starts = F.sequence(F.lit(1), F.greatest(F.size("l") - len(wanted) + 1, F.lit(1)))
    best = F.array_min(F.transform(starts, lambda i: F.struct((-count(i)).alias("minus"), i.alias("n"))))
    listed = docs.select("id", F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("l"))
    return listed.select("id", best.alias("b")).select("id", "b.n", (-F.col("b.minus")).alias("equal"))


def first_matches(docs: DataFrame, pattern: str, most: int = 100, text: str = "text") -> DataFrame:
    """(id, n, line): matching lines, the first `most` by document and line."""
    return grep(docs, pattern, 0, text).select("id", "n", "line").orderBy("id", "n").limit(most)


def window_about(docs: DataFrame, anchor: str, around: int = 5, text: str = "text") -> DataFrame:
    """(id, window): the lines about the one-based line `anchor`, cut at the text's ends; per row, without a shuffle."""
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    low = F.greatest(F.col(anchor) - around, F.lit(1))
    return docs.select("id", F.array_join(F.slice(split, low.cast("int"), (F.col(anchor) + around - low + 1).cast("int")), "\n").alias("window"))


def equal_windows(docs: DataFrame, wanted: list[str], normal=F.trim, text: str = "text") -> DataFrame:
    """(id, n): one-based first lines where consecutive lines equal the wanted ones under a normal form."""
    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: normal(x))
    goal = F.array(*[normal(F.lit(x)) for x in wanted])
    starts = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: F.slice("l", i, len(wanted)) == goal)
    return docs.select("id", split.alias("l")).select("id", F.explode(starts).alias("n"))


def note_fields(name, content) -> Column:
    """(title, headings, tags, topic) of a Markdown note: the first title, the headings below it, its tags, its folder."""
    body, key = F.coalesce(content, F.lit("")), F.regexp_replace(name, "^global/", "")
    listed = F.regexp_extract(body, r"(?m)^tags:\s*\n((?:\s*-\s*.+\n?)+)", 1)
    items = F.transform(F.regexp_extract_all(listed, F.lit(r"(?m)^\s*-\s*(.+)"), 1), lambda x: F.trim(x))
    inline = F.trim(F.regexp_extract(body, r"(?m)^tags:\s*\[(.+?)\]", 1))
    heads = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^#{2,6}\s+(.+)$"), 1), lambda x: F.trim(x))
    return F.struct(F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)).alias("title"), F.array_join(heads, "; ").alias("headings"), F.when(inline != "", inline).otherwise(F.array_join(items, ", ")).alias("tags"), F.regexp_extract(key, "^(.*)/[^/]*$", 1).alias("topic"))


def elided(text: str, keep: int = 1) -> str:
    """Python-like source with bodies deeper than `keep` levels of definitions replaced by `...`, signatures kept."""
    out, hidden = [], None
    depth: list[int] = []
    for line in text.split("\n"):
        bare, margin = line.strip(), len(line) - len(line.lstrip())
        if not bare:
            if hidden is None:
                out.append(line)
            continue
        while depth and margin <= depth[-1]:
            depth.pop()
        if hidden is not None and margin > hidden:
            continue
        hidden = None
        out.append(line)
        if re.match(r"(async\s+def|def|class)\b", bare):
            depth.append(margin)
            if bare.endswith(":") and (len(depth) >= keep + 1 or (bare.startswith(("def", "async")) and len(depth) >= keep)):
                hidden = margin
                out.append(" " * (margin + 4) + "...")
    return "\n".join(out)


def elided_files(files: DataFrame, keep: int = 1) -> DataFrame:
    """(path, text) of files (path, text) with the bodies of their definitions left out, in batches."""

    def each(frames):
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [elided(x or "", keep) for x in frame["text"]]})

    return files.select("path", "text").mapInPandas(each, f"path {files.schema['path'].dataType.simpleString()}, text string")
