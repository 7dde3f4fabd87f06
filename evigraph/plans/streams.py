"""Registered streaming queries: each drains the events table as a stream and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.code import symbols
from evigraph.plans.inputs import Inputs, oracle
from evigraph.plans.registry import query
from evigraph.session import shared_folder
from evigraph.sources.snapshot import read_snapshot, upsert_batch
from evigraph.streaming import jobs as J


def drain(spark: SparkSession, sf: str, build, mode: str = "complete") -> DataFrame:
    events = J.read_table(spark, sf, "events", Inputs(spark, sf).events.schema)
    folder = shared_folder(spark, "stream")
    J.run_available(build(events), f"{folder}/out", f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/out")


@query("st4_running_patterns", """
SELECT event_type AS pattern_key, n AS verified_outcomes, round(w, 6) AS weighted_total, round((least(w, s) + 1) / (w + 2), 6) AS confidence FROM (
 SELECT event_type, count(CASE WHEN q > 0 THEN 1 END) AS n, sum(q) AS w, sum(q * CASE WHEN value > 30 THEN 1.0 ELSE 0.5 END) AS s FROM (
  SELECT *, CAST(CASE WHEN value > 20 THEN CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.6 ELSE 0.2 END ELSE 0.0 END AS DOUBLE) AS q FROM events) e GROUP BY 1) p""")
def st4(spark: SparkSession, sf: str) -> DataFrame:
    def build(events: DataFrame) -> DataFrame:
        return J.pattern_stream(events.select(
            F.lit("p1").alias("project_id"), F.col("event_type").alias("pattern_key"), F.when(F.col("value") > 30, "success").otherwise("partial").alias("status"),
            F.when(F.col("event_type") == "purchase", "ci").when(F.col("event_type") == "signup", "test").otherwise("custom").alias("kind"),
            F.when(F.col("value") > 20, "passed").otherwise("failed").alias("verifier_status")))

    return drain(spark, sf, build).select(
        "pattern_key", "verified_outcomes", F.round("weighted_total", 6).alias("weighted_total"), F.round("confidence", 6).alias("confidence"))


@query("st5_running_status", oracle("""
SELECT episode_id, CASE WHEN max_by(result, arrival) = 'failed' THEN 'degraded' ELSE 'active' END AS status FROM m_attempts GROUP BY 1""", "m_attempts"))
def st5(spark: SparkSession, sf: str) -> DataFrame:
    def build(events: DataFrame) -> DataFrame:
        day = F.substring(F.col("ts").cast("string"), 1, 10)
        return J.status_stream(events.select(
            F.concat(F.lit("e"), F.col("user_id").cast("string"), F.lit("-"), day).alias("episode_id"), F.col("event_id").alias("arrival"),
            F.when(F.col("event_type").isin("purchase", "signup"), "success").when(F.col("event_type") == "error", "failed").otherwise("partial").alias("result")))

    events = J.read_table(spark, sf, "events", Inputs(spark, sf).events.schema)
    folder, changed = shared_folder(spark, "stream"), build(events)
    J.run_batches(changed, upsert_batch(f"{folder}/status", ["episode_id"], changed.schema), f"{folder}/state", "update")
    return read_snapshot(spark, f"{folder}/status", changed.schema)


@query("st7_running_metrics", oracle(
    "SELECT method, path, status, count(*) AS requests, round(sum(latency), 4) AS latency_sum FROM request_log GROUP BY 1, 2, 3", "request_log"))
def st7(spark: SparkSession, sf: str) -> DataFrame:
    def build(events: DataFrame) -> DataFrame:
        return J.metrics_stream(events.select(
            F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("event_type").alias("path"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency")))

    return drain(spark, sf, build).withColumn("latency_sum", F.round("latency_sum", 4))


# The watermark ends a minute before the newest event; later events wait.
@query("st3_stuck_stream", oracle("""
SELECT job_id, stage, epoch_us(ts) AS since, CASE WHEN nts IS NULL THEN 'no update' ELSE 'late update' END AS condition FROM (
 SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS nts FROM passed) t
WHERE stage NOT IN ('complete', 'failed') AND CASE WHEN nts IS NULL THEN (epoch_us(ts) + 900000000) // 1000 <= (SELECT epoch_ms(max(ts)) - 60000 FROM stage_events)
   AND job_id NOT IN (SELECT job_id FROM stage_events WHERE epoch_ms(ts) > (SELECT epoch_ms(max(ts)) - 60000 FROM stage_events)) ELSE epoch_us(nts) - epoch_us(ts) > 900000000 END""",
    "stage_events", passed="SELECT * FROM stage_events WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(ts)) - 60000 FROM stage_events)"))
def st3(spark: SparkSession, sf: str) -> DataFrame:
    def build(events: DataFrame) -> DataFrame:
        stage = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "reading").when(F.col("event_type") == "click", "chunking")
                 .when(F.col("event_type") == "purchase", "complete").otherwise("failed"))
        return J.stuck_stream(events.select(
            F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), stage.alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id"))

    return drain(spark, sf, build, "append").select("job_id", "stage", F.unix_micros("since").alias("since"), "condition")


# Three batches, the second one repeated after the third began. A text keeps its first document; its topic line is an entity.
TOPIC = "concat(text, chr(10), 'Topic ', substring(sha2(text, 256), 1, 6), ' [Topic]')"


@query("st1_intake_stream", """
SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id % 3 AS batch, 'Topic ' || substring(sha256(text), 1, 6) AS name, true AS chunked, 'succeeded' AS status FROM (
 SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id % 3, CAST(doc_id AS VARCHAR)) AS k FROM documents) d WHERE k = 1""")
def st1(spark: SparkSession, sf: str) -> DataFrame:
    docs = Inputs(spark, sf).documents.select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.expr(TOPIC).alias("text"), F.lit(0).alias("created_at"))
    folder = shared_folder(spark, "stream")
    parts = [docs.where(F.col("doc_id") % 3 == k).drop("doc_id") for k in range(3)]
    for k, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/{k}")
        arriving = spark.readStream.schema(part.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        J.run_batches(arriving, J.intake_batch(f"{folder}/store"), f"{folder}/state")
    J.intake_batch(f"{folder}/store")(parts[1], 1)
    store = {t: spark.read.parquet(f"{folder}/store/{t}") for t in ("documents", "chunks", "entities", "ledger")}
    pieces = store["chunks"].groupBy("document_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"))
    topics = store["entities"].where("type = 'Topic' AND name LIKE 'Topic %'").select("document_id", "name").distinct()
    ledger = store["ledger"].select("document_id", F.col("batch").cast("bigint").alias("batch"), "chunks", "status")
    return store["documents"].select("document_id").join(ledger, "document_id").join(pieces, "document_id").join(topics, "document_id").select(
        "document_id", "batch", "name", ((F.col("n") == F.col("chunks")) & (F.col("n") == F.col("last") + 1)).alias("chunked"), "status")


# Every part's file, then a change of every fifth one that drops a symbol: the others keep theirs.
@query("st6_file_sync", """
SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.py' AS file_path, name, CAST(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE line END AS BIGINT) AS start_line
FROM part, (VALUES ('one', 1), ('two', 3)) v(name, line) WHERE p_partkey % 5 <> 0 OR name = 'two'""")
def st6(spark: SparkSession, sf: str) -> DataFrame:
    part, folder = Inputs(spark, sf).part, shared_folder(spark, "stream")
    path = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file_path")
    first = part.select(path, F.lit("def one():\n  pass\ndef two():\n  pass\n").alias("code"), F.lit(1).alias("changed_at"))
    second = part.where("p_partkey % 5 = 0").select(path, F.lit("def two():\n  pass\n").alias("code"), F.lit(2).alias("changed_at"))
    for k, files in enumerate((first, second)):
        files.write.parquet(f"{folder}/in/{k}")
        arriving = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        J.run_batches(arriving, J.sync_batch(f"{folder}/store"), f"{folder}/state")
    found = read_snapshot(spark, f"{folder}/store", symbols(first).schema)
    return found.where("kind <> 'file'").select("file_path", "name", "start_line")


@query("st2_idempotent_stream", """
SELECT user_id, event_type, count(*) AS stored FROM (SELECT DISTINCT user_id, event_type FROM events) e GROUP BY 1, 2""")
def st2(spark: SparkSession, sf: str) -> DataFrame:
    def build(events: DataFrame) -> DataFrame:
        return J.idempotent_stream(events.select(
            F.lit("p1").alias("project_id"), F.col("event_type").alias("operation"), F.col("user_id").alias("key"), F.lit("2024-01-01").cast("timestamp").alias("ts")))

    return drain(spark, sf, build, "append").groupBy(F.col("key").alias("user_id"), F.col("operation").alias("event_type")).agg(F.count("*").alias("stored"))
