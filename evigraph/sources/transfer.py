"""Export and import of experience data, partitioned writes and user plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators.ranking import fixed_batches

PAGE = 1000


def export_episodes(episodes: DataFrame, attempts: DataFrame, outcomes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Nested episode documents. Attempts and evidence come in numbered pages, so no document grows without bound.

    Page 0 carries the episode and its outcome; ``attempts(sequence, …)`` and
    ``evidence(position, …)`` are numbered per episode.
    """
    a = attempts.groupBy("episode_id", fixed_batches(F.col("sequence"), PAGE).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("sequence", "id", "hypothesis", "action", "result"))).alias("attempts"))
    e = evidence.groupBy("episode_id", fixed_batches(F.col("position"), PAGE).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("position", "reference"))).alias("evidence"))
    first = episodes.select(F.col("id").alias("episode_id"), F.lit(0).cast("bigint").alias("page"))
    pages = first.unionByName(a.select("episode_id", "page")).unionByName(e.select("episode_id", "page")).distinct()
    o = outcomes.select("episode_id", F.struct("id", "status", "summary", "lesson").alias("outcome"))
    body = pages.join(a, ["episode_id", "page"], "left").join(e, ["episode_id", "page"], "left").join(
        o, "episode_id", "left").withColumn("outcome", F.when(F.col("page") == 0, F.col("outcome")))
    return episodes.withColumnRenamed("id", "episode_id").join(body, "episode_id")


def import_episodes(documents: DataFrame, existing: DataFrame, defaults: dict[str, object]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes, attempts, outcomes) of exported documents whose id is not stored yet."""
    new = documents.join(existing.select(F.col("id").alias("episode_id")), "episode_id", "left_anti")
    nested = ("attempts", "evidence", "outcome", "page")
    rows = new.filter("page = 0").drop(*nested)
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    attempts = new.select("episode_id", F.explode("attempts").alias("a")).select("episode_id", "a.*")
    outcomes = new.filter("outcome IS NOT NULL").select("episode_id", "outcome.*")
    return rows.withColumnRenamed("episode_id", "id"), attempts, outcomes


def write_dataset(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by project and dataset; overwriting replaces only the partitions written."""
    df.sortWithinPartitions("project_id", "dataset_id").write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(
        "project_id", "dataset_id").parquet(path)


def read_dataset(spark: SparkSession, path: str, project_id: str, dataset_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path).filter(F.col("project_id") == project_id)
    return df if dataset_id is None else df.filter(F.col("dataset_id") == dataset_id)


# Plug-ins: functions over one value, run on Arrow batches inside tasks.

EXTRACTION = (
    "chunk_id string, entities array<struct<name:string,type:string,confidence:double>>, "
    "relations array<struct<source:string,type:string,target:string,confidence:double>>"
)


def apply_extractor(chunks: DataFrame, extract: Callable[[str], tuple[list[dict], list[dict]]]) -> DataFrame:
    """User extractor ``text → (entities, relations)`` over ``chunks(chunk_id, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(t) for t in batch["text"]]
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "entities": [f[0] for f in found], "relations": [f[1] for f in found]})

    return chunks.select("chunk_id", "text").mapInPandas(run, EXTRACTION)


def apply_context_extractor(chunks: DataFrame, extract: Callable[[str, list[str]], tuple[list[dict], list[dict]]]) -> DataFrame:
    """Same with the previous chunks' texts: ``chunks(chunk_id, text, context array<string>)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(t, list(c)) for t, c in zip(batch["text"], batch["context"])]
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "entities": [f[0] for f in found], "relations": [f[1] for f in found]})

    return chunks.select("chunk_id", "text", "context").mapInPandas(run, EXTRACTION)


def apply_parser(files: DataFrame, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """User parser ``bytes → segments`` over ``files(path, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, s.get("text", ""), {k: str(v) for k, v in s.items() if k != "text"})
                    for p, c in zip(batch["path"], batch["content"]) for i, s in enumerate(parse(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "position", "text", "metadata"])

    return files.select("path", "content").mapInPandas(run, "path string, position int, text string, metadata map<string,string>")


def apply_chunker(documents: DataFrame, split: Callable[[str, str], list[str]]) -> DataFrame:
    """User chunker ``(id, text) → texts`` over ``documents(document_id, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch["document_id"], batch["text"]) for i, c in enumerate(split(d, t))]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "text"])

    return documents.select("document_id", "text").mapInPandas(run, "document_id string, chunk_index int, text string")
