"""Retrieval reports and extraction quality against golden data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.functions.scalars import normalize_name

# Phrases that mark an answer as a refusal.
REFUSALS = ("cannot answer", "can't answer", "not enough evidence", "insufficient evidence")


def retrieval_cases(golden: DataFrame, predictions: DataFrame, k: int) -> DataFrame:
    """One scored row per golden case; a case without a prediction is scored as empty."""
    p = predictions.select(
        "id", "answer", F.coalesce(F.slice("retrieved", 1, k), F.array().cast("array<string>")).alias("_got"),
        F.coalesce("citations", F.array().cast("array<string>")).alias("_cited"), "unanswerable", "latency_ms",
        "prompt_tokens", "completion_tokens", "estimated_cost_usd", F.lit(True).alias("_seen"))
    none = F.array().cast("array<string>")
    j = golden.select("id", "answerable", F.array_distinct("evidence_ids").alias("_want")).join(p, "id", "left")
    got, cited = F.coalesce("_got", none), F.coalesce("_cited", none)
    hits = F.size(F.array_intersect("_want", got))
    wanted = F.size("_want")
    refused = F.coalesce(F.col("unanswerable"), F.lit(False)) | F.lower(F.coalesce("answer", F.lit(""))).rlike("|".join(REFUSALS))
    grounded = (F.size(F.array_except(cited, got)) == 0) & F.when(F.col("answerable"), F.size(cited) > 0).otherwise(F.size(cited) == 0)
    return j.select(
        "id", F.when(wanted > 0, hits / wanted).otherwise(1.0).alias("recall_at_k"),
        F.when(wanted > 0, hits > 0).otherwise(True).alias("evidence_hit"), grounded.alias("citation_correct"),
        F.when(F.col("answerable"), ~refused).otherwise(refused).alias("unanswerable_correct"),
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"), F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("estimated_cost_usd"),
        F.col("_seen").isNull().alias("missing"))


def retrieval_report(cases: DataFrame, golden: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: macro means, nearest-rank latencies, sums, missing and extra predictions."""
    extra = predictions.join(golden.select("id"), "id", "left_anti").agg(F.count("*").alias("extra_predictions"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)")
    one = cases.agg(
        F.count("*").alias("cases"), share("recall_at_k").alias("recall_at_k"), share("evidence_hit").alias("evidence_hit_rate"),
        share("citation_correct").alias("citation_correctness"), share("unanswerable_correct").alias("unanswerable_accuracy"),
        rank(0.5).alias("latency_p50"), rank(0.95).alias("latency_p95"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("estimated_cost_usd").alias("estimated_cost_usd"),
        F.count(F.when(F.col("missing"), 1)).alias("missing_predictions"))
    return one.crossJoin(extra)


def set_scores(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of two key sets, from one full join of distinct keys."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    a = actual.select(*keys).distinct().withColumn("_a", F.lit(1))
    n = e.join(a, keys, "full").agg(
        F.count("_e").alias("expected"), F.count("_a").alias("actual"), F.count(F.when(F.col("_e").isNotNull() & F.col("_a").isNotNull(), 1)).alias("correct"))
    precision = F.when(F.col("actual") > 0, F.col("correct") / F.nullif("actual", F.lit(0))).when(F.col("expected") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("expected") > 0, F.col("correct") / F.nullif("expected", F.lit(0))).otherwise(1.0)
    scored = n.withColumn("precision", precision).withColumn("recall", recall)
    total = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))).otherwise(0.0))


def against_thresholds(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``metrics(metric, value)`` with the limit of each and whether it is met; rates of loss are upper limits."""
    upper = F.col("metric").endswith("duplicate_rate")
    return metrics.join(thresholds, "metric").withColumn(
        "passed", F.when(upper, F.col("value") <= F.col("limit")).otherwise(F.col("value") >= F.col("limit")))


def provenance(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Share of expected (entity, document) pairs that were found."""
    return set_scores(expected, actual, keys).select("expected", F.col("recall").alias("provenance_completeness"))


def duplicate_rate(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Share of entity rows beyond one per key."""
    per = entities.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(((F.sum("n") - F.count("*")) / F.nullif(F.sum("n"), F.lit(0))).alias("duplicate_rate"))


def unambiguous_relations(relations: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Relations whose two endpoint names each denote one entity of the same document."""
    names = entities.withColumn("_n", normalize_name(F.col("name"))).groupBy(*keys, "_n").agg(F.count("*").alias("_c")).filter("_c = 1").drop("_c")
    out = relations
    for side in ("source", "target"):
        out = out.withColumn("_n", normalize_name(F.col(side))).join(names, [*keys, "_n"], "left_semi").drop("_n")
    return out


def read_cases(spark, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines with an id per row, and the ids that are missing or repeated."""
    rows = spark.read.schema(schema).json(path)
    bad = rows.groupBy("id").agg(F.count("*").alias("copies")).filter("id IS NULL OR copies > 1")
    return rows, bad


