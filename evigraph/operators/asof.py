"""As-of matches over rows of any number per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import cut_lineage


def first_later(rows: DataFrame, keys: list[str], delay: int) -> DataFrame:
    """``rows(keys, t, e)`` with ``nt``, ``ne``: the first row, by (t, e), of the same key later than ``t + delay``, or null.

    Rows and their deadlines are dealt out by range over (key, time), so a hot
    key lies in many partitions; a deadline without a later row in its own
    partition takes the first row of the key in the partitions after it, of
    which only one row per partition and key is looked at.
    """
    own = F.struct("t", "e")
    nothing = F.lit(None).cast(rows.select(own.alias("r")).schema["r"].dataType)
    events = rows.select(*keys, F.col("t").alias("at"), F.lit(0).alias("deadline"), own.alias("r"), nothing.alias("of"))
    deadlines = rows.select(*keys, (F.col("t") + delay).alias("at"), F.lit(1).alias("deadline"), nothing.alias("r"), own.alias("of"))
    dealt = events.union(deadlines).repartitionByRange(*keys, "at", "deadline", F.coalesce("r", "of"))
    table = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))
    backwards = Window.partitionBy("part", *keys).orderBy(F.desc("at"), F.desc("deadline"), F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    inside = table.withColumn("next", F.last("r", ignorenulls=True).over(backwards)).where("deadline = 1")
    after = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part", *keys).agg(F.min("r").alias("first")).withColumn("beyond", F.last("first", ignorenulls=True).over(after)).drop("first")
    met = inside.join(parts, ["part", *keys]).withColumn("next", F.coalesce("next", "beyond"))
    return met.select(*keys, "of.t", "of.e", F.col("next.t").alias("nt"), F.col("next.e").alias("ne"))


def reachable(starts: DataFrame, steps: DataFrame, key: list[str], to: list[str]) -> DataFrame:
    """All rows ``key`` on the paths that begin at ``starts`` and follow ``steps(key, to)``, one step per row, without cycles.

    Pointer doubling: each round joins the reached rows with jumps of twice the
    length, so the rounds are the logarithm of the longest path.
    """
    reached, jumps = cut_lineage(starts.select(*key)), steps.where(F.col(to[0]).isNotNull()).select(*key, *to)
    while True:
        jumps = cut_lineage(jumps)
        fresh = cut_lineage(reached.join(jumps, key).select(*[F.col(t).alias(k) for k, t in zip(key, to)]))
        if not fresh.take(1):
            return reached
        reached = cut_lineage(reached.union(fresh))
        second = jumps.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(t).alias(f"_{t}") for t in to])
        on = [F.col(t) == F.col(f"_{k}") for k, t in zip(key, to)]
        jumps = jumps.join(second, on).select(*key, *[F.col(f"_{t}").alias(t) for t in to])
