"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "evigraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew join)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; make one only for local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder path inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Survives executor loss and stops plan growth in loops. Unlike a checkpoint
    it carries file sizes for join planning and no constraints of the old plan,
    whose inference grows exponentially over rounds.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_in_small_batches(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for rows with whole texts that Python works on: a worker holds a few megabytes of them at once.

    Spark's own batches have 10 000 rows, whatever their size, and the settings
    hold for the job that runs under them, so the result is written here.
    """
    conf = df.sparkSession.conf
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {key: conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            conf.set(key, value)
        return cut_lineage(df)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use all cores for heavy per-row work on an input of few splits; large inputs pass unchanged.

    ``rows`` also bounds the rows of one task, for inputs whose rows grow on the way.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def shuffled(df: DataFrame) -> DataFrame:
    """A join side that must not be broadcast.

    Spark estimates a computed side from the files it comes from. Texts built or
    exploded from a small file are many times larger than that, and a broadcast
    of them passes whole through the driver.
    """
    return df.hint("merge")
