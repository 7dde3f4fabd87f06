"""Line deduplication over the whole corpus.

Every document is exploded into its lines; a line's key is the line without
outer white space and with A-Z in lower case. Keys are hashed (two 64-bit
hashes) and the distinct documents of a hash are counted with partial sums, so
a line that a third of all documents hold never meets in one task. Lines over
the threshold go, except in the largest doc_id that holds them. Only hashes
and positions are shuffled for the decision; then each text meets the
positions that it loses once and is put together again in order.

Cases: a null or empty text is one empty line; keys below ``min_chars`` code
points always stay; rows with one doc_id count as one document, and each row
keeps its own lines; a null doc_id counts as no document and is never the
largest; nothing happens to the other columns; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import GAP_CHARS, ascii_lower, written

MIN_CHARS = 20
MIN_DOCS = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, dropped): the 0-based positions of the lines that a text loses, in no order."""
    stripped = F.btrim(F.col("line"), F.lit(GAP_CHARS))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where(
        F.char_length(stripped) >= min_chars).withColumn("key", ascii_lower(stripped))
    keyed = written(lines.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    frequent = keyed.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).where(
        F.col("n_docs") >= min_docs).drop("n_docs")
    frequent = written(frequent)  # the join then reads a plain shuffle on both sides, and Spark can split a hot line
    lost = keyed.join(frequent, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``row`` (the input row), ``kept_text``, ``n_lines`` before and ``n_dropped`` of every document."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    lost = repeated_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    joined = rows.join(lost, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    split = joined.select("row", "dropped", lines_of(F.col("row.text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return split.select("row", F.when(F.col("dropped").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(kept).alias("kept_text"),
                        F.size("lines").cast("long").alias("n_lines"),
                        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
