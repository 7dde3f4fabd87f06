"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of ``WINDOW`` words of a benchmark item (a shorter item is one
window); it occurs where a document holds the same run. As sets, windows and
documents consist of shingles of up to ``SHINGLE`` words with their positions,
and a window can only be contained where all its shingles are. Therefore

1. document shingles are joined with the benchmark's shingles, and the hits are
   counted: the global order of shingles is by rarity;
2. containment allows no missing shingle, so the necessary prefix of a window
   is its rarest one; a window with a shingle that no document holds is out;
3. only prefix shingles are joined with the hits; the shingle's place in the
   window gives the one place where the window can begin, which must lie inside
   the document, and the window must end there too (positional and length bound);
4. each candidate is verified on the words themselves.

Only (document key, position, hash) travels before step 4, and each text meets
its candidates in one join. Windows of equal words are one window, whatever
number of items hold them; items come back after the verification. Counts and
distinct rows are partial aggregates, and the joins on shingles read written
tables, which Spark may split where one shingle is in very many documents.
Everything is DataFrame functions.

Cases: null and empty texts have no words and are never contaminated; an item
without words has no window; items with a null id count as one item, which is
left out of the list of ids; repeated document rows each get their row; equal
item rows count once; an empty benchmark hits nothing, an empty corpus gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import ascii_lower, written

WINDOW = 10
SHINGLE = 5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all characters from U+0080."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingles(words: Column, size: int) -> Column:
    """(at, h) of every run of ``size`` words."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), F.slice(words, i + 1, size)).alias("h")))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): the distinct windows of every item."""
    words = items.select("item_id", item_words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i + 1, window))).alias("words")).distinct()


def _document_hits(docs: DataFrame, vocabulary: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, text_hash, n_words, at, h): the shingles of documents that the benchmark has too."""
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("words"))
    found = F.concat(*[_shingles(F.col("words"), s) for s in sizes])
    shingles = worded.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.inline(found))
    return shingles.join(vocabulary, "h")


def _candidates(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, words): the places where a window's rarest shingle allows the whole window."""
    rarity = hits.groupBy("h").agg(F.count("*").alias("seen"))
    known = windows.join(rarity, "h", "left")
    prefix = known.groupBy("window").agg(F.min(F.struct("seen", "at", "h")).alias("rarest"), F.first("words").alias("words"),
                                         F.count_if(F.col("seen").isNull()).alias("unseen")).where("unseen = 0")
    prefix = written(prefix.select(F.col("rarest.h").alias("h"), F.col("rarest.at").alias("in_window"), "words"))
    start = F.col("at") - F.col("in_window")
    met = hits.join(prefix, "h").where((start >= 0) & (start + F.size("words") <= F.col("n_words")))
    return met.select("doc_id", "text_hash", start.alias("start"), "words")


def _occurring(words: Column, candidates: Column) -> Column:
    """The candidates that ``words`` really holds."""
    return F.filter(candidates, lambda c: F.slice(words, c["start"] + 1, F.size(c["words"])) == c["words"])


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_words, spans: array of (start, words)) per document row, and the (item_id, words) windows."""
    per_item = written(item_windows(items, window))
    cut = F.least(F.size("words"), F.lit(shingle))
    sizes = sorted(r[0] for r in per_item.select(cut.alias("size")).distinct().collect())  # at most ``shingle`` values
    if not sizes:
        sizes = [shingle]
    by_size = F.lit(None).cast("array<struct<at: int, h: bigint>>")
    for s in sizes:
        by_size = F.when(cut == s, _shingles(F.col("words"), s)).otherwise(by_size)
    windows = written(per_item.select("words").distinct().select(
        F.sha2(F.array_join("words", " "), 256).alias("window"), "words", F.inline(by_size)))
    hits = written(_document_hits(docs, written(windows.select("h").distinct()), sizes))
    places = _candidates(hits, windows).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "words")).alias("candidates"))
    places = written(places).withColumnsRenamed({"doc_id": "their_id", "text_hash": "their_hash"})
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = rows.join(places, rows["doc_id"].eqNullSafe(places["their_id"]) & (F.col("text_hash") == F.col("their_hash")), "left")
    worded = joined.select("doc_id", "text_hash", item_words(F.col("text")).alias("words"), "candidates")
    none = F.array().cast("array<struct<start: int, words: array<string>>>")
    spans = F.when(F.col("candidates").isNull(), none).otherwise(_occurring(F.col("words"), F.col("candidates")))
    return worded.select("doc_id", "text_hash", F.size("words").alias("n_words"), spans.alias("spans")), per_item


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, the hit ``spans`` (start, words) and ``items`` (ids with an occurring window, sorted as strings) of every row."""
    found, per_item = occurrences(docs, items, window, shingle)
    found = written(found)
    keys = found.where(F.size("spans") > 0).select(
        F.col("doc_id").alias("their_id"), F.col("text_hash").alias("their_hash"), F.explode(F.array_distinct("spans.words")).alias("words")).distinct()
    pairs = keys.join(per_item, "words").groupBy("their_id", "their_hash").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("n_items"))
    joined = found.join(pairs, found["doc_id"].eqNullSafe(pairs["their_id"]) & (found["text_hash"] == pairs["their_hash"]), "left")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + F.size(s["words"]) - 1)))))
    return joined.select("doc_id", F.col("n_words").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), "spans",
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                         F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))
