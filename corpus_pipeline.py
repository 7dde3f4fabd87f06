"""From raw documents to a token corpus, one operator of ``evigraph.llm`` per stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and returns a DataFrame with the columns of documents (the last one: one
row of token ids per document). ``run`` writes each result and reads it again
as the next stage's docs; a mixed document is as many rows as it has copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import bpe_codec, lines, minhash, mixing, toxicity
from evigraph.llm.common import written
from evigraph.session import cut_lineage


def _with_text(docs: DataFrame, text: Column, row: str) -> list[Column]:
    """The columns of ``docs``, held in the struct ``row``, with a new text and its length."""
    fresh = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
    return [fresh.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least the threshold go. Written here, so that whole texts reach Python in small batches."""
    model = toxicity.model_for(spark, docs.select("doc_id", "text"), sf_dir)
    return written(docs.where(toxicity.score_column(F.col("text"), model) < toxicity.THRESHOLD))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go; the code points are counted anew."""
    return (out := lines.dedup_lines(docs)).select(*_with_text(docs, out["kept_text"], "row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group of near copies."""
    return minhash.first_of_groups(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of the text, their number, and whether they decode to the text; in small batches, as above."""
    coded = docs.select("doc_id", "source", bpe_codec.encode_checked(F.col("text")).alias("c"))
    return written(coded.select("doc_id", "source", F.size("c.ids").cast("long").alias("n_tokens"), "c.ids", "c.decodes"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("bpe_encode", token_ids),
]
#: The toxicity score and the token ids cannot be written in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
