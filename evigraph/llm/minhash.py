"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A text's set holds its distinct five-word shingles as 64-bit hashes. One
permutation scatters a shingle, a second one, shifted by k places, gives the
k-th signature coordinate: the least value of perm((scatter(x) + k) mod 2^32)
over the set. Bands of four coordinates are the buckets of candidates.

* Texts with equal sets are one node (128-bit digest of the set), so exact
  copies cost one row however many there are.
* A bucket is not expanded into pairs. The member with the most usual shingles
  leads, every other one is paired with it only; pairs whose coordinates agree
  far below the threshold are left, the others are confirmed on the full sets.
  Confirmed links merge components; a bucket is settled when its members lie in
  one component.
* What is left are mostly members without a link. Their pairs are not formed:
  linked sets share one of their rarest shingles, early enough in both for the
  sizes of both. Only such pairs of different components are confirmed, without
  the sketches; no pair of unsettled members is missed there. Where even these
  are many, members of other components lead once more before that, as long as
  this finds links.
* Components are kept by alternating stars.

With 32 bands of four a pair of similarity 0.75 is missed with probability
5e-6, one of 0.8 with 5e-8; the prefilter at ``SIEVE`` of 128 coordinates leaves
out a pair of 0.75 with probability below 1e-6. False links cannot occur.

Cases: a null or empty text has no set, is linked with nothing and is its own
component; fewer words than five make one shingle; a null doc_id is linked with
nothing (component null, kept); rows with the same doc_id are linked by their
texts only, and share nothing else; other columns pass unchanged; empty in,
empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType

from evigraph.llm.common import written
from evigraph.llm.components import components

WINDOW = 5
PERCENT = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
SIEVE = 68  # equal coordinates of 128; 96 are expected at a similarity of 0.75, with a deviation of 4.9
MANY = 16  # candidates for each set that shares a bucket, above which further leaders are tried first
KNOWN_WORDS = 200_000
CHUNK = 1 << 15


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; bytes.lower and bytes.split know exactly A-Z and the white space asked for."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(len(h) - WINDOW + 1, 1)
    total = np.full(n, len(words) if len(words) < WINDOW else WINDOW, np.uint64)
    for k in range(min(WINDOW, len(h))):
        total = mix64(total + h[k:k + n] * np.uint64(2 * k + 1))
    return np.unique(total)


def permute32(x: np.ndarray) -> None:
    """A bijection of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES values for each (non-empty) set; sets are worked off in chunks that stay in the cache."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        scattered = np.concatenate(sets[begin:end]).astype(np.uint32)  # the low half of a mixed hash
        permute32(scattered)
        starts = np.cumsum([0] + [len(s) for s in sets[begin:end - 1]])
        for k in range(COORDINATES):
            shifted = scattered + np.uint32(k)
            permute32(shifted)
            out[begin:end, k] = np.minimum.reduceat(shifted, starts)
        begin = end
    return out


SET_FIELDS = "n_shingles long, node binary, bands array<long>, sketch binary"


def set_column(text: Column) -> Column:
    """n_shingles, node (digest of the set), band hashes and the low bytes of the coordinates."""

    @F.pandas_udf(SET_FIELDS)
    def sets_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        salts = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in texts:
            sets = [shingles(t, known) for t in batch]
            full = [i for i, s in enumerate(sets) if len(s)]
            rows: list[tuple] = [(0, None, None, None)] * len(sets)
            if full:
                sign = signatures([sets[i] for i in full])
                bands = np.repeat(salts[None, :], len(full), 0)
                for r in range(ROWS):
                    bands = mix64(bands + sign[:, r::ROWS].astype(np.uint64))
                low = (sign & np.uint32(0xFF)).astype(np.uint8)
                for place, i in enumerate(full):
                    rows[i] = (len(sets[i]), hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(),
                               bands[place].view(np.int64), low[place].tobytes())
            yield pd.DataFrame(rows, columns=["n_shingles", "node", "bands", "sketch"])

    return sets_of(F.coalesce(text, F.lit("")))


def full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, sorted shingle hashes as bytes) of the texts whose set is that of their node."""
    known = WordHashes()
    for batch in batches:
        sets = [shingles(t, known).tobytes() for t in batch["text"]]
        own = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
        rows = [(node, x) for node, o, x in zip(batch["node"], own, sets) if bytes(node) == o]
        yield pd.DataFrame(rows, columns=["node", "hashes"], dtype=object)


@F.pandas_udf(IntegerType())
def equal_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """In how many coordinates two sketches agree."""
    if not len(a):
        return pd.Series([], dtype="int32")
    left = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    right = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series((left == right).sum(1).astype(np.int32))


@F.pandas_udf(BooleanType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two full sets (sorted distinct hashes as bytes) reach the similarity."""
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
            out.append(False)
            continue
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= PERCENT * (len(x) + len(y) - common))
    return pd.Series(out, dtype="bool")


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, bands, sketch of every document, written once."""
    return written(docs.select("doc_id", set_column(F.col("text")).alias("s")).select("doc_id", "s.*"))


def _led(buckets: DataFrame, leaders: DataFrame) -> DataFrame:
    """(leader, node) of the members that share a bucket with a leader of another component and may be linked with it, in order; pairs may repeat."""
    led = buckets.join(leaders, "bucket").where((F.col("component") != F.col("led")) & (F.col("size") <= F.col("led_room")) & (F.col("led_size") <= F.col("room")))
    return led.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node"))


def _sieved(pairs: DataFrame, nodes: DataFrame, sieve: int) -> DataFrame:
    """The pairs whose sketches agree in at least ``sieve`` places."""
    sketches = nodes.select("node", "sketch")
    first = written(pairs).join(sketches.withColumnsRenamed({"node": "leader", "sketch": "left"}), "leader")
    return written(first.join(sketches, "node").where(equal_bytes("left", "sketch") >= sieve).select("leader", "node"))


def _full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the ``wanted`` nodes, from the text of one document each."""
    need = written(nodes.join(wanted, "node", "left_semi").select("node", "rep"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(need, F.col("doc_id") == F.col("rep"))
    # a map, not a column function: the optimiser would make that a join key and compute it for every text
    return written(texts.select("node", "text").mapInPandas(full_sets, "node binary, hashes binary").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that reach the similarity on their full sets."""
    first = pairs.join(sets.withColumnsRenamed({"node": "leader", "hashes": "left"}), "leader")
    both = first.join(sets, "node").where(similar("left", "hashes"))
    return written(both.select(F.col("leader").alias("u"), F.col("node").alias("v")))


def linked_nodes(docs: DataFrame, described: DataFrame, sieve: int = SIEVE) -> DataFrame:
    """(node, component) of the nodes with a link."""
    known = described.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = written(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    rows = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    buckets = written(rows.join(shared, "bucket").select("bucket", "node"))
    wanted = written(buckets.select("node").distinct())
    sets = _full_sets(docs, nodes, wanted)
    rare = _rare_shingles(sets)
    facts = rare.groupBy("node").agg(F.first("size").alias("size"), F.first("score").alias("score"), F.max("room").alias("room"))
    held = written(buckets.join(facts, "node").withColumn("component", F.col("node")))
    links = _confirmed(_sieved(_led(held, _leaders(held, True)).distinct(), nodes, sieve), sets)
    while True:
        labels = written(components(links))
        held = _unsettled(held, labels)
        left = _rarely_shared(rare, held)
        more = None
        if left.count() > MANY * wanted.count():  # several large groups in one bucket: let another one's member lead
            more = _confirmed(_sieved(_led(held, _leaders(held, False)).distinct(), nodes, sieve), sets)
        if more is None or more.isEmpty():
            more = _confirmed(written(left.distinct()), sets)
            return labels if more.isEmpty() else written(components(links.union(more)))
        links = links.union(more)


def _unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the buckets whose members lie in several components, with the component."""
    other = [c for c in rows.columns if c != "component"]
    held = written(rows.drop("component").join(labels, "node", "left").select(*other, F.coalesce("component", "node").alias("component")))
    several = held.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
    return written(held.join(several, "bucket"))


def _leaders(rows: DataFrame, everyone: bool) -> DataFrame:
    """(bucket, leader, led, led_size, led_room): the member of each bucket with the most usual shingles, of equal ones the larger; unless ``everyone`` may lead, one outside its largest component."""
    if not everyone:
        sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m")).select("bucket", F.col("m.component").alias("largest"))
        rows = rows.join(largest, "bucket").where(F.col("component") != F.col("largest"))
    best = rows.groupBy("bucket").agg(F.max(F.struct("score", "size", "node", "component", "room")).alias("m"))
    return written(best.select("bucket", F.col("m.node").alias("leader"), F.col("m.component").alias("led"),
                               F.col("m.size").alias("led_size"), F.col("m.room").alias("led_room")))


@F.pandas_udf(ArrayType(LongType()))
def as_numbers(hashes: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, np.int64) for x in hashes], dtype=object)


def _rare_shingles(sets: DataFrame) -> DataFrame:
    """(node, size, score, shingle, room) of the rarest shingles of each set; the score is the mean number of sets that hold a shingle.

    In the order of rarity, a shingle at place i (from 0) that is the first one that a set of size s shares with another leaves them at most
    s - i in common; they are linked only if the other's size is at most ``room`` = (100 + PERCENT) / PERCENT * (s - i) - s. A shingle
    that leaves no room for a size of PERCENT of s is no first one of a link. A set without such a shingle has no links among ``sets``.
    """
    rows = sets.select("node", (F.octet_length("hashes") / 8).cast("long").alias("size"), F.explode(as_numbers("hashes")).alias("shingle"))
    known = written(rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1"))
    of_node = W.partitionBy("node")
    placed = rows.join(known, "shingle").select(
        "node", "size", "shingle", (F.sum("held").over(of_node) / F.col("size")).alias("score"),
        (F.count("*").over(of_node) - F.row_number().over(of_node.orderBy("held", "shingle")) + 1).alias("left"))  # s - i: those held once come first
    room = F.floor(F.col("left") * (100 + PERCENT) / PERCENT) - F.col("size")
    return written(placed.select("node", "size", "score", "shingle", room.alias("room")).where(100 * F.col("room") >= PERCENT * F.col("size")))


def _rarely_shared(rare: DataFrame, buckets: DataFrame) -> DataFrame:
    """(leader, node) of the pairs of different components among ``buckets`` that share a rare shingle with room for each other: all that may be linked.

    Members of the largest component among those that hold a shingle do not lead, and rows that have no room for any other holder are left out first.
    """
    rows = written(rare.drop("score").join(buckets.select("node", "component").distinct(), "node"))
    parts = rows.groupBy("shingle", "component").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("room").alias("most"))
    whole = parts.groupBy("shingle").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts"), F.min("least").alias("least"), F.max("most").alias("most"))
    whole = written(whole.where("parts > 1").select("shingle", F.col("m.component").alias("largest"), "least", "most"))
    rows = written(rows.join(whole, "shingle").where("room >= least AND size <= most").drop("least", "most"))
    leaders = rows.where("component <> largest").select("shingle", F.col("node").alias("leader"), F.col("component").alias("led"), F.col("size").alias("led_size"), F.col("room").alias("led_room"))
    return _led(rows.withColumnRenamed("shingle", "bucket"), leaders.withColumnRenamed("shingle", "bucket"))


def duplicate_groups(docs: DataFrame, sieve: int = SIEVE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of the component) of every document."""
    described = describe(docs.select("doc_id", "text"))
    labels = linked_nodes(docs.select("doc_id", "text"), described, sieve)
    known = described.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    own = known.groupBy("node").agg(F.min("doc_id").alias("least"))
    classed = written(own.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    smallest = written(classed.groupBy("component").agg(F.min("least").alias("component_id")))
    ids = written(classed.join(smallest, "component").select(F.col("node").alias("of"), "component_id"))
    out = described.select("doc_id", "n_shingles", "node").join(ids, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_groups(docs: DataFrame, sieve: int = SIEVE) -> DataFrame:
    """``docs`` without the documents that are linked, over others, to one of a smaller id. Of rows with one id and text the repeats stay."""
    gone = written(duplicate_groups(docs, sieve).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
