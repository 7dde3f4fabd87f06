"""Structured Streaming jobs: intake, idempotency, stuck work, patterns, status, sync, metrics, refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from evigraph.functions.scalars import is_promoted, outcome_score, smoothed_confidence, verifier_weight
from evigraph.operators import code as K
from evigraph.operators import communities as C
from evigraph.operators.chunking import number_chunks, split_segments
from evigraph.operators.extraction import deterministic
from evigraph.operators.governance import STALE_SECONDS
from evigraph.session import cut_lineage
from evigraph.sources.corpus import flag_duplicates
from evigraph.sources.snapshot import change_snapshot


def read_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Stream of one table's Parquet files inside a folder of tables."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "complete") -> None:
    """Process all input there is, keeping the result as Parquet.

    Complete mode rewrites the result per batch, append mode adds to it; a batch
    that is retried after a failure writes to the same place again.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(target)
        else:
            batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run_batches(stream, put, checkpoint, mode)


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    # keyed state with lists and timers is kept by this store
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


HASHES = StructType([StructField("content_hash", StringType()), StructField("document_id", StringType())])


def intake_batch(store: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch handler: keep new documents of ``(document_id, text, created_at)``, chunk them, extract by the fixed rules and keep a ledger.

    Which contents are known is a table of hashes, of which a batch reads and
    rewrites only the buckets of its own hashes. Output folders carry the batch
    number, so a retried batch meets the hashes as they were before it and
    replaces its own output and nothing else.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        docs = cut_lineage(flag_duplicates(batch.withColumn("content_hash", F.sha2("text", 256)), ["content_hash"]).filter(~F.col("duplicate")).drop("duplicate"))
        own = docs.select(*HASHES.names)
        known = change_snapshot(f"{store}/hashes", batch_id + 1, own, ["content_hash"], HASHES,
                                lambda old, new: old.unionByName(new.join(old, "content_hash", "left_anti")), buckets)
        docs.join(known.select("content_hash"), "content_hash", "left_anti").write.mode("overwrite").parquet(f"{store}/documents/batch={batch_id}")
        added = spark.read.schema(docs.schema).parquet(f"{store}/documents/batch={batch_id}")
        chunks = number_chunks(split_segments(added, ["document_id", "content_hash"]), "document_id", ["segment_part"], "content_hash")
        chunks.write.mode("overwrite").parquet(f"{store}/chunks/batch={batch_id}")
        chunks = spark.read.schema(chunks.schema).parquet(f"{store}/chunks/batch={batch_id}")
        entities, _ = deterministic(chunks, ["document_id", "chunk_id"])
        entities.write.mode("overwrite").parquet(f"{store}/entities/batch={batch_id}")
        entities = spark.read.schema(entities.schema).parquet(f"{store}/entities/batch={batch_id}")
        counted = added.select("document_id", "content_hash").join(
            chunks.groupBy("document_id").agg(F.count("*").alias("chunks")), "document_id", "left").join(
            entities.groupBy("document_id").agg(F.count("*").alias("entities")), "document_id", "left")
        counted.select("document_id", "content_hash", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("entities", F.lit(0)).alias("entities"),
                       F.lit("succeeded").alias("status")).write.mode("overwrite").parquet(f"{store}/ledger/batch={batch_id}")

    return handle


def idempotent_stream(requests: DataFrame, hours: int = 24) -> DataFrame:
    """First request of each (project, operation, key) inside the time to live."""
    return requests.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["project_id", "operation", "key"])


_STUCK = "job_id string, stage string, since timestamp, condition string"
MINUTE_US = 60_000_000


def _stuck_rows(rows: list[tuple[str, str, int, str]]) -> pd.DataFrame:
    """Plain object columns: the state serializer takes no chunked Arrow strings."""
    columns = list(zip(*rows)) or [(), (), (), ()]
    since = pd.to_datetime(pd.Series(columns[2], dtype="int64"), unit="us")
    return pd.DataFrame({"job_id": pd.Series(columns[0], dtype=object), "stage": pd.Series(columns[1], dtype=object), "since": since,
                         "condition": pd.Series(columns[3], dtype=object)})


class StuckWatch(StatefulProcessor):
    """Watches the open stage of one job.

    Events wait in a list until the watermark has passed them, so they are
    judged by (time, event id) whatever batch or block brought them. A timer
    after the first waiting minute wakes the job, which then takes all that has
    passed, and one at the end of the allowed time finds a stage without an
    update. Blocks go to the list as they come; what one watermark step lets
    pass is sorted at once. Times are microseconds, timers and watermarks milliseconds.
    """

    def __init__(self, stale_seconds: int) -> None:
        self.stale = stale_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, stage string")
        self.open = handle.getValueState("open", "stage string, since long")

    def _wake_after(self, at: int) -> None:
        self.handle.registerTimer((at // MINUTE_US + 1) * MINUTE_US // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for block in rows:
            at = block["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), block["event_id"].tolist(), block["stage"].tolist())))
            self._wake_after(int(at.min()))
        yield _stuck_rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for event in self.waiting.get():
            (due if event[0] // 1000 <= passed else later).append(tuple(event))
        stage, since = self.open.get() if self.open.exists() else (None, None)
        found = []
        for at, _, name in sorted(due):
            if stage is not None and at - since > self.stale:
                found.append((key[0], stage, since, "late update"))
            stage, since = (None, None) if name in DONE else (name, at)
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        if later:
            self._wake_after(min(later)[0])
        if stage is not None and not later and (since + self.stale) // 1000 <= passed:  # a waiting event will be its late update
            found.append((key[0], stage, since, "no update"))
            stage = None
        elif stage is not None and due:
            self.handle.registerTimer((since + self.stale) // 1000)
        if stage is None:
            self.open.clear()
        else:
            self.open.update((stage, since))
        yield _stuck_rows(found)

    def close(self) -> None:
        pass


DONE = ("complete", "failed")


def stuck_stream(events: DataFrame, stale_seconds: int = STALE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Jobs whose open stage saw no event for too long: a gap seen in the data, or an expired timer.

    ``events(job_id, stage, ts, event_id)``; one row per stale stage, once the
    watermark has passed it. Needs the RocksDB state store (see ``run_available``).
    """
    return events.withWatermark("ts", delay).groupBy("job_id").transformWithStateInPandas(
        StuckWatch(stale_seconds), _STUCK, "append", "EventTime")


def pattern_stream(outcomes: DataFrame) -> DataFrame:
    """Running pattern rows from ``(project_id, pattern_key, status, kind, verifier_status)`` outcome events."""
    quality = verifier_weight(F.col("kind"), F.col("verifier_status"))
    sums = outcomes.withColumn("_q", quality).groupBy("project_id", "pattern_key").agg(
        F.sum("_q").alias("weighted_total"), F.sum(F.col("_q") * outcome_score(F.col("status"))).alias("weighted_successes"),
        F.count(F.when(F.col("_q") > 0, 1)).alias("verified_outcomes"))
    return sums.withColumn("confidence", smoothed_confidence(F.col("weighted_successes"), F.col("weighted_total"))).withColumn(
        "promoted", is_promoted(F.col("verified_outcomes"), F.col("confidence")))


def status_stream(attempts: DataFrame, order: str = "arrival") -> DataFrame:
    """Running episode status: the last attempt decides, which is a plain aggregate. In update mode a batch gives the changed episodes only."""
    last = attempts.groupBy("episode_id").agg(F.max_by("result", order).alias("result"))
    return last.select("episode_id", F.when(F.col("result") == "failed", "degraded").otherwise("active").alias("status"))


def metrics_stream(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path", "status").agg(F.count("*").alias("requests"), F.sum("latency").alias("latency_sum"))


def sync_batch(store: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch handler for changed files ``(file_path, code, changed_at)``: the symbols of these files are replaced in their buckets."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = cut_lineage(batch.groupBy("file_path").agg(F.max_by("code", "changed_at").alias("code")))
        change_snapshot(store, batch_id + 1, newest, ["file_path"], K.symbols(newest).schema, K.sync_files, buckets)

    return handle


def refresh_batch(store: str, project_id: str, dataset_id: str, load: Callable[[SparkSession], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """Batch handler: recompute analytics when the graph's digest has changed."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        C.refresh(batch.sparkSession, store, project_id, dataset_id, *load(batch.sparkSession))

    return handle


