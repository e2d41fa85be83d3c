"""A map of ranked files as an indented tree, as much of it as a token budget takes.

Folders are drawn once for all files in them, so that a file's cost depends on those before it: each folder is charged to its best file.
Then the size of every prefix of the ranked files is a running sum, and the search for the prefix that is drawn needs no drawing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes a token has, how far a map may pass its budget, and the fewest bytes of a line.
BYTES_A_TOKEN, TOLERANCE, LEAST_LINE = 4, 0.15, 1


def _marginal(files: DataFrame) -> DataFrame:
    """(path, place, cost): the bytes that a placed file (path, place, content) adds to the tree of those before it."""
    parts = files.select("place", "path", "content", F.split("path", "/", -1).alias("p"))
    depth = F.size("p") - 1
    drawn = F.filter(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda line: line != "")
    text = F.aggregate(drawn, F.lit(0).cast("long"), lambda s, line: s + F.octet_length(line) + 2 * depth + 5)
    own = parts.select("path", "place", (2 * depth + F.octet_length(F.element_at("p", -1)) + 1 + text).alias("own"))
    above = parts.where(depth > 0).select("place", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("p", 1, k), "/").alias("folder"), F.octet_length(F.get(F.col("p"), k - 1)).alias("name")))).alias("x"))
    first = above.groupBy("x.folder").agg(F.min("place").alias("place"), F.first(2 * (F.col("x.k") - 1) + F.col("x.name") + 2).alias("cost"))
    charged = first.groupBy("place").agg(F.sum("cost").alias("above"))
    return own.join(charged, "place", "left").select("path", "place", (F.col("own") + F.coalesce("above", F.lit(0))).alias("cost"))


def accepted(tokens: list[int], files: int, budget: int) -> int:
    """How many of so many files are drawn, by the token counts of the first prefixes; longer ones are over the tolerance.

    A binary search keeps the largest map that it meets within the budget or near it; one file is always drawn.
    """
    low, high, best, most = 1, files, 0, 0
    while low <= high:
        mid = (low + high) // 2
        n = tokens[mid - 1] if mid <= len(tokens) else None
        if n is not None and n > most and (n <= budget or abs(n - budget) / budget < TOLERANCE):
            best, most = mid, n
        if n is not None and n < budget:
            low = mid + 1
        else:
            high = mid - 1
    return min(max(best, 1), files)


def placed_files(ranked: DataFrame, budget: int) -> DataFrame:
    """(path, place, used, content) of the files (path, score, content) that are drawn, the best first and smaller paths at ties; each path once.

    Only as many files are sorted in one place as a map of this budget could hold at all, a line for each.
    """
    if budget < 1:
        raise ValueError("a budget has a token at least")
    best = ranked.where("path is not null").groupBy("path").agg(F.max(F.struct("score", "content")).alias("x")).select("path", "x.score", "x.content")
    most = int(budget * (1 + TOLERANCE) * BYTES_A_TOKEN) // LEAST_LINE + BYTES_A_TOKEN
    order = [F.desc("score"), F.asc("path")]
    head = best.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    costs = _marginal(head).withColumn("used", F.sum("cost").over(Window.orderBy("place")))
    sizes = costs.where(F.col("used") < (budget * (1 + TOLERANCE) + 1) * BYTES_A_TOKEN).orderBy("place").select("used").collect()  # bounded by the budget, as `head` is
    n = accepted([r["used"] // BYTES_A_TOKEN for r in sizes], best.count(), budget)
    return head.join(costs.select("place", "used"), "place").where(F.col("place") <= n).select("path", "place", "used", "content")


def drawn(placed: DataFrame) -> DataFrame:
    """(n, line): the tree of placed files (path, content), folders before files and both by name; as large as the budget allows."""
    parts = placed.select("content", F.split("path", "/", -1).alias("p"))
    depth = F.size("p") - 1
    step = lambda k, folder: F.struct(F.lit(0 if folder else 1).alias("o"), F.get(F.col("p"), k - 1).alias("name"))
    indent = lambda k: F.repeat(F.lit("  "), k)
    nothing = F.array().cast("array<struct<o:int,name:string>>")
    folder_key = lambda k: F.transform(F.sequence(F.lit(1), k), lambda j: step(j, True))
    folders = parts.where(depth > 0).select(F.explode(F.transform(F.sequence(F.lit(1), depth), lambda k: F.struct(folder_key(k).alias("key"), F.lit(0).alias("m"), F.concat(indent(k - 1), F.get(F.col("p"), k - 1), F.lit("/")).alias("line")))).alias("x")).select("x.*").distinct()
    key = F.concat(F.when(depth > 0, folder_key(depth)).otherwise(nothing), F.array(step(F.size("p"), False)))
    lines = F.filter(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda line: line != "")
    texts = F.concat(F.array(F.concat(indent(depth), F.element_at("p", -1))), F.transform(lines, lambda line: F.concat(indent(depth), F.lit("    "), line)))
    files = parts.select(key.alias("key"), F.posexplode(texts).alias("m", "line"))
    return folders.unionByName(files).select(F.row_number().over(Window.orderBy("key", "m")).alias("n"), "line")


def tree_map(ranked: DataFrame, budget: int) -> DataFrame:
    """(n, line): the map of ranked files (path, score, content) that a budget takes. No files: no lines."""
    return drawn(placed_files(ranked, budget))
