"""Guards on edits, as column expressions over a table of edits, and the receipts that satisfy them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import first_non_empty, glob_regex

MOST_LINES, MOST_FILES, MOST_RATIO = 50, 1, 0.30
#: File extensions of the bounded language label, the order of priorities of a build.
LABELS = {"go": ["go"], "typescript": ["ts", "tsx", "js", "jsx", "mjs", "cjs"], "python": ["py"]}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def language_label(path) -> Column:
    extension, found = F.lower(F.regexp_extract(_col(path), r"\.([^./]*)$", 1)), F.lit("other")
    for label, endings in LABELS.items():
        found = F.when(extension.isin(endings), label).otherwise(found)
    return found


def renames_by_text(find, symbols) -> Column:
    """A text edit of what is a symbol's whole name, of three letters or more."""
    return _col(find).rlike(r"^[A-Za-z_]\w{2,}$") & F.array_contains(_col(symbols), _col(find))


def large_edit(lines, files, file_lines=None, ratio: bool = False) -> Column:
    big = (_col(lines) > MOST_LINES) | (_col(files) > MOST_FILES)
    if ratio and file_lines is not None:
        big = big | F.coalesce((_col(file_lines) > 0) & (_col(lines) / F.nullif(_col(file_lines), F.lit(0)) > MOST_RATIO), F.lit(False))
    return big


def public_edit(visibility, reachable, signature_change, references) -> Column:
    """An edit of what others may see: public, reachable from an entry point, or a changed signature that is referred to."""
    return F.coalesce(_col(visibility).isin("public", "exported", "protected"), F.lit(False)) | _col(reachable) | (_col(signature_change) & (_col(references) > 0))


def unchecked_delete(removes, tracked, has_exports, receipts) -> Column:
    """A removal in a tracked file without the receipt it needs: of impact where something is exported, else of references or impact."""
    impact, refs = F.array_contains(_col(receipts), "impact_checked"), F.array_contains(_col(receipts), "references_checked")
    return _col(removes) & _col(tracked) & ~F.when(_col(has_exports), impact).otherwise(impact | refs)


def security_signals(path, name, imports, globs: list[str], names: list[str], packages: list[str]) -> Column:
    """Which of path_glob, identifier and import_pattern mark an edit as touching security."""
    some = lambda c, patterns: F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)
    by_path = some(_col(path), [glob_regex(g) for g in globs])
    by_import = F.coalesce(F.exists(_col(imports), lambda x: some(x, packages)), F.lit(False))
    return F.array_compact(F.array(F.when(by_path, "path_glob"), F.when(some(_col(name), names), "identifier"), F.when(by_import, "import_pattern")))


def action(triggered, *layers) -> Column:
    """allow, warn or block, by the first layer that names a level; `off` allows, and no layer warns."""
    level = F.coalesce(first_non_empty(*layers), F.lit("warn"))
    return F.when(~_col(triggered) | (level == "off"), "allow").when(level == "block", "block").otherwise("warn")


def valid_receipts(receipts: DataFrame, now, ttl_seconds: int, most: int) -> DataFrame:
    """Receipts (session, receipt, used_at, issued_at, version, current) that still count: not outlived, of the graph's
    current version, and among the `most` of their session that were used last."""
    alive = receipts.where((F.col("issued_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now) & (F.col("version") == F.col("current")))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("used_at"), F.desc("receipt")))
    return alive.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def lanes(files: DataFrame, most: int, by: str = "repo", order: tuple = ("priority", "path")) -> DataFrame:
    """(..., place): the next `most` of each repository by priority and path; the rest is left out before anything is gathered."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return files.withColumn("place", place).where(F.col("place") <= most)


def pending_reason(status, reason, allowed: list[str]) -> Column:
    """The reason of a pending file out of a closed list; null for a file that is not pending."""
    return F.when(_col(status) == "pending", F.when(_col(reason).isin(allowed), _col(reason)).otherwise("other"))


def chosen_source(available, fresh, covered) -> Column:
    """(source, fallback_reason): semantic facts where they are there, fresh and cover the file."""
    reason = F.when(~_col(available), "index_unavailable").when(~_col(covered), "not_covered").when(~_col(fresh), "stale")
    return F.struct(F.when(reason.isNull(), "semantic").otherwise("fallback").alias("source"), reason.alias("fallback_reason"))
