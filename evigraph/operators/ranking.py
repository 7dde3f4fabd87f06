"""Ranking helpers that never send one whole hot group to a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.session import cut_lineage


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark keeps only ``n`` per key and map task before it shuffles."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept.withColumn(name, F.col(name).cast("bigint")) if rank else kept.drop(name)


def sequence_in_group(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "sequence"
) -> DataFrame:
    """Exact row numbers per key, sorted in (key, bucket) pieces.

    ``bucket`` must grow with the order (an hour, an id range). Pieces are
    numbered on their own and shifted by the running row count of the earlier
    buckets, so a key that holds a third of all rows is still spread out.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    piece = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(piece))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_row") + F.col("_offset")).cast("bigint"))
        .drop("_row", "_offset", "_bucket")
    )


def fixed_batches(sequence: Column, size: int) -> Column:
    """Batch number of a 1-based sequence cut every ``size`` rows."""
    return F.floor((sequence - 1) / size).cast("bigint")


def keyset_page(df: DataFrame, key: str, limit: int, cursor: str | None = None) -> DataFrame:
    """One page after ``cursor``; ``next_cursor`` is set when a further row exists."""
    rows = df if cursor is None else df.filter(F.col(key) > F.lit(cursor))
    ahead = rows.orderBy(key).limit(limit + 1)
    everything = Window.partitionBy(F.lit(0)).orderBy(key)
    numbered = ahead.withColumn("_row", F.row_number().over(everything))
    whole = Window.partitionBy(F.lit(0))
    return (
        numbered.withColumn("_more", F.max("_row").over(whole) > limit)
        .withColumn("_last", F.max(F.when(F.col("_row") <= limit, F.col(key))).over(whole))
        .filter(F.col("_row") <= limit)
        .withColumn("next_cursor", F.when(F.col("_more"), F.col("_last")))
        .drop("_row", "_more", "_last")
    )


def all_pages(df: DataFrame, key: str, page_size: int) -> DataFrame:
    """Page number of every row in key order, without one global sort task.

    Rows are cut into key ranges of about equal size and written to the
    checkpoint folder, so range borders cannot move between the two passes.
    Ranges are numbered on their own and shifted by the count of earlier ranges.
    """
    ranged = df.repartitionByRange(F.col(key)).withColumn("_slice", F.spark_partition_id())
    ranged = cut_lineage(ranged.withColumn("_all", F.lit(0)))
    numbered = sequence_in_group(ranged, ["_all"], F.col("_slice"), [F.col(key)], "_seq")
    return numbered.withColumn("page", fixed_batches(F.col("_seq"), page_size) + 1).drop("_seq", "_all", "_slice")
