"""SimHash fingerprints and search within a Hamming radius, in DataFrame functions only.

Terms are a text's five-word shingles (a shorter text is one shingle), hashed
to 64 bits; a term votes on every bit of the fingerprint, up if its bit is set
and down if not, with its frequency as weight. Votes of eight bits are counted at
once in eight 8-bit lanes of one 64-bit number, over parts of at most 127
terms, so no lane overflows. A bit is set if more than half of the votes are up.

Search: the 64 bits are cut into ``BLOCKS`` blocks; two fingerprints within
``radius`` bits agree on at least BLOCKS - radius of them. One table for each
choice of that many blocks holds the fingerprints with those blocks moved to
the front as the key; equal keys are the candidates, and the exact distance
decides. Equal fingerprints are one row before the tables are built.

Cases: a null text counts as empty; a text without words has the fingerprint
0; words are taken as they are written; repeated rows get a fingerprint each,
and rows with one doc_id have one successor, the largest smaller id; of several
texts of one id the largest counts as its text there; a null doc_id has no
neighbour (its edited text gets nothing in exchange, near_next is null); with a
single id, a document is its own successor; empty in, empty out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm.common import words, written
from evigraph.llm.quality import let

WINDOW = 5
BITS = 64
LANES, LANE_BITS = 8, 8
LANE_MASK = 0x0101010101010101
PART = 127
RADIUS = 3
BLOCKS = 6


def term_hashes(text: Column) -> Column:
    """The hashes of the five-word shingles of a text, repeats included; of the whole word sequence if it is shorter."""
    def of_words(hashes: Column) -> Column:
        n = F.size(hashes)
        many = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return F.when(n >= WINDOW, many).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of_words)


def _lanes(terms: Column, shift: int) -> Column:
    """How many of at most PART terms have the bits shift, shift + 8, .. shift + 56: eight counts in one number."""
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(LANE_MASK)))


def fingerprint(text: Column) -> Column:
    """The 64-bit SimHash of a text."""
    def of_terms(terms: Column) -> Column:
        n = F.size(terms)
        parts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(PART)), lambda i: F.slice(terms, i, PART))

        def of_parts(cut: Column) -> Column:
            bits = F.lit(0).cast("long")
            for shift in range(LANE_BITS):
                bits = bits.bitwiseOR(let(F.transform(cut, lambda part: _lanes(part, shift)), lambda sums: _majority(sums, n, shift)))
            return bits

        return let(parts, of_parts)

    return let(term_hashes(text), of_terms)


def _majority(sums: Column, n: Column, shift: int) -> Column:
    """The bits of the lanes whose counts, summed over the parts, exceed half of n, each at its place in the fingerprint."""
    bits = F.lit(0).cast("long")
    for lane in range(LANES):
        count = F.aggregate(sums, F.lit(0).cast("long"), lambda a, s: a + F.shiftrightunsigned(s, lane * LANE_BITS).bitwiseAND(F.lit((1 << LANE_BITS) - 1)))
        place = lane * LANE_BITS + shift
        value = (1 << place) - (1 << BITS if place == BITS - 1 else 0)
        bits = bits.bitwiseOR(F.when(2 * count > n, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def block_keys(fp: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """One (table, key) for each choice of blocks - radius blocks; a key holds the bits of the chosen blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask -= 1 << BITS if mask >= 1 << (BITS - 1) else 0
        keys.append(F.struct(F.lit(table).alias("table"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*keys)


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct (query, found) of one-column frames of fingerprints: all ``found`` within ``radius`` bits of ``query``."""
    def table(frame: DataFrame, name: str) -> DataFrame:
        one = frame.toDF(name).where(F.col(name).isNotNull()).distinct()
        return one.select(name, F.explode(block_keys(F.col(name), radius, blocks)).alias("t")).select(name, "t.table", "t.key")

    found = table(queries, "query").join(table(fingerprints, "found"), ["table", "key"])
    return found.where(distance(F.col("query"), F.col("found")) <= radius).select("query", "found").distinct()


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, n_chars) to (doc_id, prev_id, prev_chars): of which document this is the next one, descending id, round the end.

    Ids are dealt out by ranges; inside a range a window looks one row back,
    and the first row of a range looks at the last row of the range before.
    """
    one = ids.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    dealt = written(one.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()))
    inside = W.partitionBy("range").orderBy("doc_id")
    # descending order: the document before mine has the next larger id
    rows = dealt.select("range", "doc_id", "n_chars", F.lead("doc_id").over(inside).alias("p"), F.lead("n_chars").over(inside).alias("c"))
    firsts = dealt.groupBy("range").agg(F.min_by(F.struct("doc_id", "n_chars"), "doc_id").alias("first"))
    # one row per range: the first row of the next range, or of the first one
    border = W.orderBy("range")
    every = border.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nexts = firsts.select(F.col("range").alias("r"), F.coalesce(F.lead("first").over(border), F.first("first").over(every)).alias("n"))
    joined = rows.join(F.broadcast(nexts), F.col("range") == F.col("r"))  # a row per partition of the shuffle
    return joined.select("doc_id", F.coalesce("p", "n.doc_id").alias("prev_id"), F.coalesce("c", "n.n_chars").alias("prev_chars"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp of every document, written."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.where(F.col("doc_id").isNotNull())
    links = written(successors(known.select("doc_id", F.char_length("text").alias("n_chars"))))
    # what a document sends to the one before it: its beginning and its fingerprint. Both joins deal the texts out by the
    # same id, so Spark shuffles them once and reads that shuffle twice; the own fingerprint is cheaper made anew than sent
    sent = known.join(links.hint("shuffle_merge"), "doc_id").select(
        F.col("prev_id").alias("to"), F.expr("left(text, cast(prev_chars div 3 as int))").alias("head"), fingerprint(F.col("text")).alias("next_fp"))
    received = sent.groupBy("to").agg(F.max(F.struct("head", "next_fp")).alias("n"))
    joined = known.join(received.hint("shuffle_merge"), F.col("doc_id") == F.col("to"))
    kept = F.expr("left(text, cast(char_length(text) - char_length(text) div 3 as int))")
    edited = joined.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.concat(kept, "n.head").alias("edited"), fingerprint(F.col("text")).alias("fp"), F.col("n.next_fp").alias("next_fp"))
    alone = texts.where(F.col("doc_id").isNull()).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), kept.alias("edited"), fingerprint(F.col("text")).alias("fp"), F.lit(None).cast("long").alias("next_fp"))
    return written(edited.union(alone).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", fingerprint(F.col("edited")).alias("edited_fp"), "next_fp"))


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def report(docs: DataFrame, query_step: int = 100, radius: int = RADIUS) -> DataFrame:
    """The fingerprints of every document and its edited text with their likenesses; n_close: other fingerprints within
    ``radius`` bits, for the documents whose id ``query_step`` divides (null for the rest)."""
    rows = compared(docs)
    asked = rows.where(F.col("doc_id") % query_step == 0).select("fp").distinct()
    close = written(within_radius(asked, rows.select("fp"), radius).groupBy("query").agg((F.count("*") - 1).alias("n_close")))
    joined = rows.join(close, (F.col("fp") == F.col("query")) & (F.col("doc_id") % query_step == 0), "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_close")
