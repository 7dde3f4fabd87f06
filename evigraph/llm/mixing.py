"""Mixing of sources to target weights by whole and random repetitions.

Words are summed per source (partial sums first, so a source with a third of
all rows costs nothing extra). Every source gets a target: a share of
``total_ratio`` times all words in proportion to its weight, held at
``max_rate`` times its own words; what a held source leaves goes to the others
by weight. With sources in rising order of cap / weight, the level at which
the shares stand is the largest of (total - caps before) / (weights from here
on), so no loop is needed. A document is emitted floor(rate) times, rate =
target / words of the source, and once more if a number in [0, 1) taken from a
hash of the seed and its id is below the fraction. Reruns agree.

Cases: a null text has size 0; a null source is a source of its own, last in
order; a source without words has target 0 and rate 0; a null id hashes as an
empty one; repeated rows get the same number of copies each; empty in, empty
out. The windows run over one row per source, never over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm.common import words
from evigraph.session import cut_lineage

WEIGHTS = (3, 1, 2)
TOTAL_RATIO = 1.5
MAX_RATE = 2.0
SEED = "mix-1"
SALTS = 32


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_ratio: float = TOTAL_RATIO,
                   max_rate: float = MAX_RATE) -> DataFrame:
    """(source, size) rows to one (source, source_size, target) row per source."""
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = totals.select("source", "source_size", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), place + 1).alias("weight")).withColumn(
        "cap", F.col("source_size") * F.lit(max_rate))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = weighted.select("source", "source_size", "weight", "cap", (
        (F.sum("source_size").over(every) * F.lit(total_ratio) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward)).alias("level"))
    return levels.select("source", "source_size", F.least(
        F.col("cap"), F.max("level").over(every) * F.col("weight")).alias("target"))


def _with_copies(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...], total_ratio: float, max_rate: float, seed: str) -> DataFrame:
    """``rows`` (a struct ``row`` with doc_id and source) with the figures of their source and their copies.

    The plan has a row per source. It is written, so the join knows its size:
    broadcast below Spark's threshold; else a sort-merge join in which the rows
    of one source go to SALTS tasks.
    """
    plan = cut_lineage(source_targets(sizes, weights, total_ratio, max_rate).select(
        F.col("source").alias("plan_source"), "source_size", "target", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")))
    salted = rows.withColumn("own_salt", F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS)).cast("int"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (unit_hash(F.col("row.doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return salted.join(plan, F.col("row.source").eqNullSafe(F.col("plan_source")) & (F.col("own_salt") == F.col("salt"))).select(
        *rows.columns, "source_size", "target", copies.alias("copies"))


def repetitions(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_ratio: float = TOTAL_RATIO,
                max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``row`` (the input row without its text), size, source_size, target and copies of every document."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    sized = cut_lineage(docs.select(F.struct(*rest).alias("row"), F.size(words(F.col("text"))).cast("long").alias("size")))
    return _with_copies(sized, sized.select("row.source", "size"), weights, total_ratio, max_rate, seed)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_ratio: float = TOTAL_RATIO,
        max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed documents, each as often as it is taken, with the columns of ``docs``."""
    sizes = docs.select("source", F.size(words(F.col("text"))).cast("long").alias("size"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = _with_copies(rows, sizes, weights, total_ratio, max_rate, seed)
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
