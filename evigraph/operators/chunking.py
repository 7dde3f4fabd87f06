"""Overlapping, boundary-aware chunks with exact segment offsets."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from evigraph.functions.scalars import stable_id, token_count
from evigraph.operators.ranking import fixed_batches
from evigraph.sources.corpus import WHITESPACE, strip

SIZE, OVERLAP = 1200, 200
PIPELINE_VERSION = "chunks-v1"

_PIECES = ArrayType(StructType([
    StructField("text", StringType()), StructField("start_char", IntegerType()), StructField("end_char", IntegerType())]))


def _ranges(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open ranges that cover the text; see ``_cut_long`` for where they end.

    The places after a newline or space are listed once; each range looks up the
    last one that it reaches.
    """
    places = [m.end() for m in re.finditer("[\n ]", text)]
    ranges = [(0, 0)]
    while ranges[-1][1] < len(text):
        begin = max(ranges[-1][0] + 1, ranges[-1][1] - overlap) if ranges[-1][1] else 0
        limit = begin + size
        reached = bisect_right(places, limit) - 1
        natural = places[reached] if reached >= 0 else 0
        cut = natural if natural - begin > size // 2 + 1 else limit
        ranges.append((begin, len(text) if limit >= len(text) else cut))
    return ranges[1:]


def _cut_long(size: int, overlap: int):
    """Arrow UDF cutting texts longer than one chunk.

    A slice in Python costs its own length, while a JVM substring walks from the
    start of the text each time, so a fold over built-ins was quadratic in the
    text. A cut falls after the last newline or space of the window when that
    lies in its second half; every longer separator ends in one of these two.
    """

    def trimmed(text: str) -> list[dict]:
        found = ((begin, text[begin:end]) for begin, end in _ranges(text, size, overlap))
        lefts = ((begin + len(raw) - len(raw.lstrip()), raw.strip()) for begin, raw in found)
        return [{"text": value, "start_char": at, "end_char": at + len(value)} for at, value in lefts if value]

    @F.pandas_udf(_PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(trimmed, na_action="ignore")

    return cut


def chunk_pieces(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of trimmed chunks with offsets. Texts of one chunk never leave the JVM."""
    if size <= overlap or overlap < 0:
        raise ValueError("chunk size must exceed a non-negative overlap")
    value = strip(text)
    left = F.length(text) - F.length(F.ltrim(text, F.lit(WHITESPACE)))
    single = F.filter(F.array(F.struct(
        value.alias("text"), left.alias("start_char"), (left + F.length(value)).alias("end_char"))), lambda c: c["text"] != "")
    short = F.length(text) <= size
    return F.coalesce(F.when(short, single), _cut_long(size, overlap)(F.when(~short, text)))


def split_segments(
    segments: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP,
) -> DataFrame:
    """Trimmed chunks of each segment with ``start_char``, ``end_char``, ``segment_part`` and ``segment_count``.

    All work stays inside the row of its segment. A segment of at most one chunk
    size, such as a short page, stays whole.
    """
    cut = segments.withColumn("_chunks", chunk_pieces(F.col(text), size, overlap))
    return (
        cut.withColumn("segment_count", F.size("_chunks").cast("bigint"))
        .select(*keys, "segment_count", F.posexplode("_chunks").alias("_part", "_chunk"))
        .select(
            *keys, (F.col("_part") + 1).cast("bigint").alias("segment_part"), "segment_count",
            F.col("_chunk.start_char").cast("bigint").alias("start_char"),
            F.col("_chunk.end_char").cast("bigint").alias("end_char"), F.col("_chunk.text").alias("text"),
        )
    )


def number_chunks(chunks: DataFrame, document_id: str, order: list[str], content_hash: str,
                  version: str = PIPELINE_VERSION) -> DataFrame:
    """Document-wide ``chunk_index``, persisted id and token count.

    One document is one source file, so its chunks are the bounded group here.
    """
    w = Window.partitionBy(document_id).orderBy(*order)
    return (
        chunks.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("bigint"))
        .withColumn("token_count", token_count(F.col("text")))
        .withColumn("chunk_id", stable_id("chunk", F.col(document_id), F.col(content_hash), F.lit(version), F.col("chunk_index")))
    )


def replace_chunks(stored: DataFrame, fresh: DataFrame, document_id: str = "document_id") -> DataFrame:
    """Re-ingested documents lose their old chunks; others keep theirs."""
    return stored.join(fresh.select(document_id).distinct(), document_id, "left_anti").unionByName(fresh)


def context_windows(chunks: DataFrame, document_id: str, index: str, batch_size: int, previous: int) -> DataFrame:
    """(chunk, context chunk) pairs: the ``previous`` chunks before the start of each chunk's batch.

    The context of a batch is an index range, so it is an equi join of batch
    starts with shifted indexes and never a self product.
    """
    batched = chunks.withColumn("batch", fixed_batches(F.col(index) + 1, batch_size))
    wanted = (
        batched.select(document_id, "batch").distinct()
        .withColumn("_offset", F.explode(F.sequence(F.lit(1), F.lit(previous))))
        .withColumn("context_index", F.col("batch") * batch_size - F.col("_offset"))
        .filter(F.col("context_index") >= 0).drop("_offset")
    )
    return batched.select(document_id, index, "batch").join(wanted, [document_id, "batch"])
