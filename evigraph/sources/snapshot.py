"""A keyed table of which a change rewrites only the buckets that it touches.

Rows lie in ``buckets`` folders by the hash of their key. A version writes the
touched buckets anew and, last, a list of the version that each bucket is read
from; a reader takes the list of the newest version, so a half-written version
is never seen, and a repeated one replaces its own files. Old versions stay
until they are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigraph.session import cut_lineage


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _places(spark: SparkSession, store: str, before: int | None = None) -> dict[int, int]:
    """Bucket → version of the newest list, or of the newest one below ``before``."""
    versions = sorted(int(n[1:]) for n in _names(spark, f"{store}/lists") if n.startswith("v"))
    versions = [v for v in versions if (before is None or v < before) and "_SUCCESS" in _names(spark, f"{store}/lists/v{v}")]
    if not versions:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{store}/lists/v{versions[-1]}").collect()}  # one row per bucket


def _load(spark: SparkSession, store: str, places: dict[int, int], schema: StructType) -> DataFrame:
    folders = [f"{store}/rows/v{version}/bucket={bucket}" for bucket, version in places.items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    return _load(spark, store, _places(spark, store), schema)


def change_snapshot(
    store: str, version: int, changes: DataFrame, keys: list[str], schema: StructType,
    merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 64,
) -> DataFrame:
    """Write ``version``: ``merge(old rows, changes)`` of the buckets that ``changes`` touches. Returns the old rows of these buckets.

    ``buckets`` grows with the table, not with a change; it must stay the same
    for all versions of a store.
    """
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    places = _places(spark, store, version)
    touched = sorted(r[0] for r in changes.select(bucket.alias("b")).distinct().collect())  # at most ``buckets``
    old = _load(spark, store, {b: places[b] for b in touched if b in places}, schema)
    merged = merge(old, changes).select(*schema.names).withColumn("bucket", bucket)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/rows/v{version}")
    filled = {int(n.split("=")[1]) for n in _names(spark, f"{store}/rows/v{version}") if n.startswith("bucket=")}
    places = {b: v for b, v in places.items() if b not in touched} | {b: version for b in filled}
    spark.createDataFrame(sorted(places.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{store}/lists/v{version}")
    return old


def upsert(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows replace old ones of the same key."""
    return old.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def upsert_batch(store: str, keys: list[str], schema: StructType, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch handler of a stream in update mode: the rows of a batch replace those of the same key."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        change_snapshot(store, batch_id + 1, cut_lineage(batch), keys, schema, lambda old, new: upsert(old, new, keys), buckets)

    return handle
