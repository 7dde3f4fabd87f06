"""Places of rows inside ordered groups, without a window over a whole group.

Rows are dealt out by range over (group, order) and sorted inside a partition;
a place is the place in the partition plus the rows of the group in earlier
partitions. Only one row per partition and group is ever summed up, so a group
that holds a third of all rows is spread over a third of the partitions. Equal
rows are told apart by the place of their input row, so they can be spread too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import written

_PART_BITS = 33  # monotonically_increasing_id: the partition above, the place in it below


def sorted_parts(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` as a written table with ``part`` and ``idx``: parts follow each other in the order of (group, order), nulls first."""
    keys = [*group, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    place = F.monotonically_increasing_id()
    return written(dealt.withColumn("_at", place).select(
        *rows.columns, F.shiftright("_at", _PART_BITS).alias("part"), F.col("_at").bitwiseAND((1 << _PART_BITS) - 1).alias("idx")))


def group_runs(table: DataFrame, group: list[str]) -> DataFrame:
    """(part, group, first, n, before): the rows of a group in a partition, where they begin, and how many lie in earlier ones."""
    runs = table.groupBy("part", *group).agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def placed(table: DataFrame, runs: DataFrame, group: list[str], more: list[str] = ()) -> DataFrame:
    """The rows of ``table`` with ``pos``, their 0-based place in the group, and the columns ``more`` of their run."""
    own = [c for c in table.columns if c not in ("part", "idx")]
    keys = ["part", *group]
    there = runs.select(*[F.col(c).alias(f"_{c}") for c in keys], (F.col("before") - F.col("first")).alias("_shift"), *more)
    joined = table.join(there, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]))
    return joined.select(*own, (F.col("idx") + F.col("_shift")).alias("pos"), *more)
