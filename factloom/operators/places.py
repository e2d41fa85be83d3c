"""Places in a total order, of tables that no task can hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Below this bit of a row's number is its place in its task, above it the task.
TASK_BIT = 33


def with_places(rows: DataFrame, order: list[str | Column], cut: Callable[[DataFrame, str], DataFrame], groups: list[str] | None = None, tasks: int | None = None, place: str = "place") -> DataFrame:
    """rows with their place, from 0, in that order: within each group, where groups are the first columns of the order.

    The rows are dealt out by ranges of the order and numbered within their task; what lies before a task's first row of a group
    is a sum over the tasks' counts, a table of a row for each task and group in it. So no task holds a group. Rows that are
    equal in the whole order meet in one task: add a column that tells them apart. `cut(df, name)` writes the numbered rows,
    as a range that is sampled again might be another.
    """
    groups = groups or []
    n = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "places")
    own = own.withColumn("_task", F.shiftright("_at", TASK_BIT)).withColumn("_n", F.col("_at").bitwiseAND((1 << TASK_BIT) - 1))
    counts = own.groupBy(*groups, "_task").agg(F.count("*").alias("_held"), F.min("_n").alias("_first"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_task").alias("_of"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_task") == F.col("_of")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return own.join(shift, same).select(*rows.columns, (F.col("_n") + F.col("_shift")).alias(place))
