"""Removal of repeated byte strings across documents, by suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id. Documents are too many and too long for one
suffix order, so the work is dealt out without losing a match:

1. Every LENGTH-byte window picks the least hash of its SEED-byte grams (the
   first of equal ones). Equal windows pick equal grams, so grouping by the
   gram's hash brings all copies of a window together. Each task looks for
   grams that several of its documents share and sends one row for each gram
   on; a group by gram hash finds those shared across tasks. So a passage that
   a third of all documents hold sends a row per task, not per document.
2. Documents with shared grams are cut into segments: all windows that picked
   one gram, 50 to 84 bytes. Equal segments are one row with their least doc_id.
3. Segments of some gram groups at a time form a collection whose Burrows-
   Wheeler transform and common prefixes are built column by column in files
   (``bwt.Collection``). Rows with a common prefix of at least LENGTH are copies
   of one window; its owner is the least doc_id among them. Segments that
   cannot share a window with another one of their group (neither the bytes up
   to nor those from the middle of the reach around the gram agree) stay out.
   A gram whose segments have more than GRAM_BYTES is dealt out instead: a
   window lies at one place around its gram, so the owner of a window is a
   plain minimum over the segments that hold it (``hot_owners``).
4. The owners go back to the documents of a segment; windows with an owner
   smaller than the document are lost, overlaps are merged, and the remaining
   bytes are joined.

Cases: a null text counts as empty; texts below LENGTH bytes lose nothing; rows
with one doc_id do not lose bytes to each other; a null doc_id counts as larger
than every id; a copy inside one document is no loss; other columns pass
unchanged; empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.bwt import Collection
from evigraph.llm.common import discard, written

LENGTH = 50
SEED = 16
NO_ID = (1 << 63) - 1
FLUSH_GRAMS = 4_000_000
FLUSH_SEGMENTS = 100_000
COLLECTION_BYTES = 600_000
GRAM_BYTES = 2_400_000
ROUNDS = 4

def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the SEED bytes from each place on, from their two halves as numbers."""
    halves = np.ndarray(len(data) - SEED // 2 + 1, "<u8", data, strides=(1,)).copy()
    h = halves[:-(SEED // 2)] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += halves[SEED // 2:]
    h *= np.uint64(0xD1B54A32D192ED03)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place of the gram, first window, last window) of the maximal runs of windows that pick the same gram."""
    if len(data) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    h = gram_hashes(data)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    reach, width = LENGTH - SEED + 1, 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[:width - reach], least[reach - width:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return h[place[first]].view(np.int64), place[first], first, np.append(first[1:], len(place)) - 1


def _grouped(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their keys: keys, docs, starts of the groups, and whether a group has several documents."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys, docs, starts, np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts)


SINGLE, SHARED, FOUND = 0, 1, 2


def find_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, gram, kind): grams of one document of the task, one mark for each shared gram, and the documents of shared grams."""
    def combine(grams: list[np.ndarray], docs: list[np.ndarray]) -> pd.DataFrame:
        keys, owners, starts, several = _grouped(np.concatenate(grams), np.concatenate(docs))
        inside = np.repeat(several, np.diff(np.append(starts, len(keys))))
        one, marks = starts[~several], starts[several]
        return pd.DataFrame({
            "doc": np.concatenate([owners[one], np.full(len(marks), NO_ID), owners[inside]]),
            "gram": np.concatenate([keys[one], keys[marks], keys[inside]]),
            "kind": np.repeat(np.array([SINGLE, SHARED, FOUND], np.int32), [len(one), len(marks), int(inside.sum())])})

    grams, docs, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc"].to_numpy(), batch["text"]):
            own = np.unique(segments(text.encode("utf-8", "surrogatepass"))[0])
            if len(own):
                grams.append(own)
                docs.append(np.full(len(own), doc))
                held += len(own)
            if held >= FLUSH_GRAMS:
                yield combine(grams, docs)
                grams, docs, held = [], [], 0
    if held:
        yield combine(grams, docs)


def match_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, gram) of the rows, sorted by gram, whose gram has a mark or a second row."""
    keys, docs, kinds = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def settle(keys: np.ndarray, docs: np.ndarray, kinds: np.ndarray) -> pd.DataFrame:
        if not len(keys):
            return pd.DataFrame({"doc": docs, "gram": keys})
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        shared = (np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts)) | (np.maximum.reduceat(kinds, starts) == SHARED)
        want = np.repeat(shared, sizes) & (kinds == SINGLE)
        return pd.DataFrame({"doc": docs[want], "gram": keys[want]})

    for batch in batches:
        known = batch[batch["kind"] == FOUND]
        if len(known):
            yield known[["doc", "gram"]]
        rest = batch[batch["kind"] != FOUND]
        keys = np.concatenate([keys, rest["gram"].to_numpy()])
        docs = np.concatenate([docs, rest["doc"].to_numpy()])
        kinds = np.concatenate([kinds, rest["kind"].to_numpy()])
        if len(keys):
            cut = np.searchsorted(keys, keys[-1])  # the last gram may go on in the next batch
            yield settle(keys[:cut], docs[:cut], kinds[:cut])
            keys, docs, kinds = keys[cut:], docs[cut:], kinds[cut:]
    yield settle(keys, docs, kinds)


CUT_FIELDS = "row long, doc long, starts array<int>, k1s array<long>, k2s array<int>, at int, content binary, least long, most long"
CUT_SCHEMA = pa.schema([
    ("row", pa.int64()), ("doc", pa.int64()), ("starts", pa.list_(pa.int32())), ("k1s", pa.list_(pa.int64())), ("k2s", pa.list_(pa.int32())),
    ("at", pa.int32()), ("content", pa.binary()), ("least", pa.int64()), ("most", pa.int64())])


def _keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A long and an int of each 128-bit digest."""
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], (both[:, 1] & 0x7FFFFFFF).astype(np.int32)


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document a row with the starts and keys of its shared segments; per distinct segment of the task a row with its bytes and least and largest document."""
    known: dict[bytes, list] = {}

    def rows_of(**columns: list) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in CUT_SCHEMA], schema=CUT_SCHEMA)

    def flush() -> pa.RecordBatch:
        at, least, most, _ = zip(*known.values()) if known else ((), (), (), ())
        out = rows_of(content=list(known), at=at, least=least, most=most)
        known.clear()
        return out

    for batch in batches:
        rows, docs, all_starts, all_k1, all_k2 = [], [], [], [], []
        for row, doc, text, grams in zip(batch["row"].to_pylist(), batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["grams"]):
            data = text.encode("utf-8", "surrogatepass")
            gram, place, first, last = segments(data)
            wanted = np.sort(grams.values.to_numpy())
            shared = wanted[np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)] == gram
            if not shared.any():
                continue
            starts, digests = first[shared], []
            for s, e, at in zip(starts.tolist(), (last[shared] + LENGTH).tolist(), (place - first)[shared].tolist()):
                content = data[s:e]
                seen = known.get(content)
                if seen is None:
                    seen = known[content] = [at, doc, doc, xxhash.xxh3_128_digest(content)]
                elif doc < seen[1]:
                    seen[1] = doc
                elif doc > seen[2]:
                    seen[2] = doc
                digests.append(seen[3])
            k1, k2 = _keys(digests)
            rows.append(row)
            docs.append(doc)
            all_starts.append(starts.astype(np.int32))
            all_k1.append(k1)
            all_k2.append(k2)
            if len(known) >= FLUSH_SEGMENTS:
                yield flush()
        yield rows_of(row=rows, doc=docs, starts=all_starts, k1s=all_k1, k2s=all_k2)
    yield flush()


def owners(contents: list[bytes], least: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """For each string runs of windows with one owner: (ends of the runs, owners)."""
    collection = Collection(contents)
    who, offset, row = collection.rows_of(LENGTH)
    group = np.cumsum(collection.lcp < LENGTH)
    best = np.full(group[-1] + 1, NO_ID)
    np.minimum.at(best, group[row], least[who])
    owner = best[group[row]]
    order = np.lexsort((offset, who))
    who, owner = who[order], owner[order]
    new = np.append(True, (who[1:] != who[:-1]) | (owner[1:] != owner[:-1]))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(who))
    base = np.searchsorted(who, who[begin])
    out: list[tuple[list[int], list[int]]] = [([], []) for _ in contents]
    for i, upto, o in zip(who[begin].tolist(), (end - base).tolist(), owner[begin].tolist()):
        out[i][0].append(upto)
        out[i][1].append(o)
    return out


OWNER_FIELDS = "k1 long, k2 int, ends array<int>, owners array<long>"


def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Owners of the windows of the segments (only where a document can lose one), rows sorted by gram; collections end between grams."""
    half = (LENGTH - SEED) // 2
    held: dict[bytes, list] = {}
    waiting: list[tuple[bytes, int, int, list]] = []
    size, current = 0, None
    out: list[tuple] = []

    def judge() -> None:
        nonlocal size
        if waiting:
            least = np.array([x[1] for *_, x in waiting], np.int64)
            for (content, begin, end, x), (ends, who) in zip(waiting, owners([c[b:e] for c, b, e, _ in waiting], least)):
                if x[2] > min(who):
                    if begin:  # the windows outside the part are no other segment's
                        ends, who = [begin, *(e + begin for e in ends)], [x[1], *who]
                    if end < len(content):
                        ends, who = [*ends, len(content) - LENGTH + 1], [*who, x[1]]
                    out.append((content, ends, who))
        waiting.clear()
        size = 0

    def close_gram() -> None:
        nonlocal size
        if len(held) > 1:
            # a window that two different segments share holds the half reach before the gram or the half reach behind it:
            # it begins at most, or at least, half the reach before the gram
            sides = [(c[at - half:at + SEED] if at >= half else None, c[at:at + SEED + half] if len(c) >= at + SEED + half else None)
                     for c, (at, _, _) in held.items()]
            left, right = Counter(a for a, _ in sides), Counter(b for _, b in sides)
        for n, (content, x) in enumerate(held.items()):
            before = behind = False
            if len(held) > 1:
                before, behind = (side is not None and count[side] > 1 for side, count in zip(sides[n], (left, right)))
            if before or behind:
                begin, end = 0 if before else max(x[0] - half, 0), len(content) if behind else x[0] - half + LENGTH
                waiting.append((content, begin, end, x))
                size += end - begin
            elif x[1] < x[2]:
                out.append((content, [len(content) - LENGTH + 1], [x[1]]))
        held.clear()

    def settled() -> pd.DataFrame:
        contents, ends, who = zip(*out) if out else ((), (), ())
        k1, k2 = _keys([xxhash.xxh3_128_digest(c) for c in contents])
        out.clear()
        return pd.DataFrame({"k1": k1, "k2": k2, "ends": pd.Series(ends, dtype=object), "owners": pd.Series(who, dtype=object)})

    for batch in batches:
        for at, content, lo, hi in zip(*(batch[c].tolist() for c in ("at", "content", "least", "most"))):
            gram = content[at:at + SEED]
            if gram != current:
                close_gram()
                current = gram
                if size >= COLLECTION_BYTES:
                    judge()
            seen = held.get(content)
            if seen is None:
                held[content] = [at, lo, hi]
            else:
                seen[1], seen[2] = min(seen[1], lo), max(seen[2], hi)
        yield settled()
    close_gram()
    judge()
    yield settled()


def hot_grams(contents: DataFrame, gram_bytes: int) -> DataFrame:
    """Grams with segments of more than ``gram_bytes``: at most one for so many bytes of segments, so they can be sent to all tasks."""
    return contents.groupBy("gram").agg(F.sum(F.length("content")).alias("n")).where(F.col("n") > gram_bytes).select("gram")


def hot_owners(contents: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Owners as ``decide`` gives them, without a task that sees a whole gram, and the tables to discard after use.

    A segment may have several rows: one for its own copies and one for windows
    whose owner is smaller than all of these. The windows of a segment end at
    least half the reach before the gram or begin behind that; they are compared
    only if another segment has the same bytes on that side.
    """
    @F.pandas_udf("k1 long, k2 int")
    def content_keys(contents: pd.Series) -> pd.DataFrame:
        k1, k2 = _keys([xxhash.xxh3_128_digest(c) for c in contents])
        return pd.DataFrame({"k1": k1, "k2": k2})

    half = (LENGTH - SEED) // 2
    merged_rows = contents.groupBy("at", "content").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    distinct = written(merged_rows.select(content_keys("content").alias("k"), "at", "content", "least", "most").select("k.*", "at", "content", "least", "most"))
    last = F.length("content") - LENGTH
    copies = distinct.where(F.col("least") < F.col("most")).select("k1", "k2", F.array(last + 1).alias("ends"), F.array("least").alias("owners"))

    def side(begin: Column, low: Column, high: Column) -> Column:
        return F.when(low <= high, F.struct(F.substring("content", begin + 1, F.lit(SEED + half)).alias("shared"), low.alias("low"), high.alias("high")))

    at = F.col("at")
    sides = F.array_compact(F.array(side(at - half, F.lit(0), F.least(at - half, last)), side(at, F.greatest(at - half + 1, F.lit(0)), last)))
    sided = distinct.select("k1", "k2", "at", "content", "least", F.explode(sides).alias("s")).select(
        "k1", "k2", "content", "least", "s.*", (F.col("s.high") > at - half).alias("behind"))
    several = sided.groupBy("behind", "shared").agg(F.count("*").alias("n")).where("n > 1").select("behind", "shared")
    kept = sided.join(several, ["behind", "shared"], "left_semi")
    windows = written(kept.select("k1", "k2", "content", "least", F.explode(F.sequence("low", "high")).alias("begin")).select(
        "k1", "k2", "least", "begin", F.substring("content", F.col("begin") + 1, F.lit(LENGTH)).alias("window")))
    best = windows.groupBy("window").agg(F.min("least").alias("owner"), F.max("least").alias("top")).where("owner < top").select("window", "owner")
    lost = windows.join(best, "window").where(F.col("owner") < F.col("least"))
    runs = lost.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("begin", "owner"))).alias("w"))
    next_to = lambda a, b: (a["begin"] + 1 == b["begin"]) & (a["owner"] == b["owner"])
    firsts = F.filter("w", lambda x, i: ~F.coalesce(next_to(F.get("w", i - 1), x), F.lit(False)))
    lasts = F.filter("w", lambda x, i: ~F.coalesce(next_to(x, F.get("w", i + 1)), F.lit(False)))
    pairs = F.arrays_zip(firsts.alias("f"), lasts.alias("l"))
    shared = runs.select(
        "k1", "k2", F.flatten(F.transform(pairs, lambda r: F.array(r["f"]["begin"], r["l"]["begin"] + 1))).alias("ends"),
        F.flatten(F.transform(pairs, lambda r: F.array(F.lit(NO_ID), r["l"]["owner"]))).alias("owners"))  # nobody owns what lies between runs
    return written(copies.unionByName(shared)), [distinct, windows]


def lost_spans(docs: DataFrame, gram_bytes: int = GRAM_BYTES) -> DataFrame:
    """(row, spans): the half-open byte spans, unordered and overlapping, that a row loses; row is a hash of id and text."""
    rows = docs.select(row_key().alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc", "text").mapInPandas(find_grams, "doc long, gram long, kind int")
    place = F.when(F.col("kind") == FOUND, F.xxhash64("doc", "gram")).otherwise(F.col("gram"))
    dealt = found.repartition(place).sortWithinPartitions("gram")
    shared = written(dealt.mapInPandas(match_grams, "doc long, gram long"))
    per_doc = shared.groupBy("doc").agg(F.collect_set("gram").alias("grams")).withColumnRenamed("doc", "of")
    cut = written(rows.join(per_doc, F.col("doc") == F.col("of")).select("row", "doc", "text", "grams").mapInArrow(cut_segments, CUT_FIELDS))
    discard(shared)
    gram = F.expr(f"substring(content, at + 1, {SEED})")
    contents = cut.where(F.col("content").isNotNull()).select("at", "content", "least", "most", gram.alias("gram"))
    hot = written(hot_grams(contents, gram_bytes))
    parts = []
    if not hot.isEmpty():
        own, used = hot_owners(contents.join(F.broadcast(hot), "gram", "left_semi"))
        contents = contents.join(F.broadcast(hot), "gram", "left_anti")
        parts.append(own)
        for table in used:
            discard(table)
    parts += [written(contents.where(F.pmod(F.xxhash64(F.lit(1), "gram"), F.lit(ROUNDS)) == k).repartition("gram").sortWithinPartitions("gram").mapInPandas(decide, OWNER_FIELDS))
              for k in range(ROUNDS)]  # all grams, a part of them at a time: the shuffle files of a round go when it ends
    owned = reduce(DataFrame.union, parts)
    pieces = cut.where(F.col("starts").isNotNull()).select("row", "doc", F.explode(F.arrays_zip("starts", "k1s", "k2s")).alias("p")).select(
        "row", "doc", F.col("p.starts").alias("start"), F.col("p.k1s").alias("k1"), F.col("p.k2s").alias("k2"))
    joined = pieces.join(owned, ["k1", "k2"])
    begin = F.transform("ends", lambda e, i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1)))
    spans = F.transform(
        F.filter(F.arrays_zip(begin.alias("b"), F.col("ends"), F.col("owners")), lambda r: r["owners"] < F.col("doc")),
        lambda r: F.struct((F.col("start") + r["b"]).alias("begin"), (F.col("start") + r["ends"] + (LENGTH - 1)).alias("end")))
    lost = joined.select("row", F.explode(spans).alias("span"))
    out = written(lost.groupBy("row").agg(F.collect_set("span").alias("spans")))
    for table in (cut, hot, *parts):
        discard(table)
    return out


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [tuple(x) for x in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for begin, end in spans:
        parts.append(data[at:begin])
        at = end
    return b"".join([*parts, data[at:]])


def remove_repeats(docs: DataFrame, gram_bytes: int = GRAM_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document; ``gram_bytes`` bounds the segments of a gram in one task."""
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def apply(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for text, b, e in zip(texts, begins, ends):
            data = text.encode("utf-8", "surrogatepass")
            spans = merged(list(zip(b, e))) if b is not None else []
            kept = without(data, spans)
            rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    docs = docs.select("doc_id", "text")
    lost = lost_spans(docs, gram_bytes).withColumnRenamed("row", "of")
    joined = docs.withColumn("row", row_key()).join(lost, F.col("row") == F.col("of"), "left")
    return joined.select("doc_id", apply(F.coalesce("text", F.lit("")), F.col("spans.begin"), F.col("spans.end")).alias("r")).select("doc_id", "r.*")
