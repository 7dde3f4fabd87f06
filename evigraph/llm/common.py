"""Small column helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.session import cut_lineage

WORD_GAP = "[ \\x09-\\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of characters other than blank and U+0009..U+000D; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    files, spark = df.inputFiles(), df.sparkSession
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for large jobs: small Arrow batches, and the shuffle files of the job go as soon as the table is written."""
    conf = df.sparkSession.conf
    settings = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    before = {key: conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            conf.set(key, value)
        return cut_lineage(df)
    finally:
        for key, value in before.items():
            conf.set(key, value)
