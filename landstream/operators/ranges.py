"""Windows over ranges: a key's rows in their order, spread over many tasks, with what stands at the borders carried over.

A window over a key puts the key in one task. Here rows are dealt in ranges of (keys, order) and written once with the range's
number; windows run within (keys, range), and each range's last and first rows go on to the ranges after and before it, by a window
over one row a key and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import kept

RANGE = "__range"

#: Rows that a task sorts or groups at a time.
TASK_ROWS = 500_000


def tasks(df: DataFrame) -> int:
    """How many tasks the rows of df fill. Counts df: of files without a filter, their footers."""
    return -(-df.count() // TASK_ROWS)


def dealt(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df dealt by keys to n tasks, so that the memory of a task doesn't grow with the table; fewer than the session's number of
    shuffle partitions leave that number to the session. What groups and joins by these keys and others then stays in its task."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with the number of its range; ranges follow the order of (keys, order), and equal rows share one."""
    ranged = df.repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys), *(F.col(c).asc_nulls_first() for c in order)).withColumn(RANGE, F.spark_partition_id())
    return kept(ranged, "ranges")


def within(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, RANGE).orderBy(*order)


def carried(ranged: DataFrame, keys: list[str], order: list[str], before: Column | None = None, after: Column | None = None) -> DataFrame:
    """ranged with `__before`, the last non-null `before` in earlier ranges of its key, and `__after`, the first non-null `after` in later ones."""
    at, over = F.struct(*order), Window.partitionBy(*keys).orderBy(RANGE)
    edges, made = [], {}
    if before is not None:
        edges.append(F.max_by(before, F.when(before.isNotNull(), at)).alias("__b"))
        made["__before"] = F.last("__b", True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    if after is not None:
        edges.append(F.min_by(after, F.when(after.isNotNull(), at)).alias("__a"))
        made["__after"] = F.first("__a", True).over(over.rowsBetween(1, Window.unboundedFollowing))
    known = ranged.groupBy(*keys, RANGE).agg(*edges).withColumns(made)
    known = known.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col(RANGE).alias("__at"), *made)
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys), F.col(RANGE) == F.col("__at"))
    return ranged.join(known, same).drop("__at", *(f"__key_{k}" for k in keys))
