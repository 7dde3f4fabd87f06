"""Prefix trie of rebuilt conversations, as a distributed burst trie.

A turn's id is a digest of its role and text; a conversation is the sequence of
its turn ids. Conversations of equal sequences are first merged into one with a
weight, by partial aggregates. A *container* holds the suffixes below one trie
head; all begin in the container of the root. A container with more than
``CONTAINER_TURNS`` remaining turns bursts: its head becomes a node, and its
suffixes go on, one turn shorter, to the containers of their next turn id (a
suffix that is used up ends at the head). Containers within the bound are dealt
to shards by head, sorted by their turn ids and swept once, each suffix opening
the nodes that it does not share with the one before. Burst heads get the sums
of their subtrees from their children, deepest first. So no task holds a
container above the bound, whatever first turn or head is hot; a single suffix
longer than that is a chain, whose nodes are written row by row. Rounds follow
the depth to which oversized containers share turns, not the data.

Text is read once; afterwards only ids, lengths and positions travel. The
digest of a node's ends is one SHA-256 over many ids, so it is fed in order
from blocks of at most ``ID_BLOCK`` ids.

Cases: rows without conv_id belong to no conversation; null role or text is
empty; turns of equal number (nulls first) are ordered by the digest of role
and text, so repeated rows are repeated turns; a conversation whose rebuilt form
has no turn is a member of the root and ends there; an empty table has no node;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import written
from evigraph.llm.numbering import group_runs, placed, sorted_parts

BASE = 100
MAX_HEAD = 6
CONTAINER_TURNS = 4096
ID_BLOCK = 10_000
HEAD = ["h1", "h2"]
NODES = ("p1 long, p2 long, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, end_rep long")
NODE_COLUMNS = [part.split()[0] for part in NODES.split(", ")]


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string")) % MAX_HEAD


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, chars): the turns of every conversation in order, from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 32)).alias("turn_id"),
        F.char_length(text).cast("long").alias("chars"))
    table = sorted_parts(turns, ["conv_id"], ["turn", "turn_id"])
    return written(placed(table, group_runs(table, ["conv_id"]), ["conv_id"]).drop("turn"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, pos, turn_id, chars) and all conversations (conv_id)."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns(
        {"base": F.col("conv_id") - F.col("conv_id") % BASE, "h": head_length(F.col("conv_id"))})
    convs = written(convs)
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))))
    heads = turns.where((F.col("conv_id") % BASE == 0) & (F.col("pos") < MAX_HEAD)).withColumnRenamed("conv_id", "base")
    first = convs.select("conv_id", "base", "h").join(heads, "base").where("pos < h").select("conv_id", "pos", "turn_id", "chars")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "chars")
    return written(first.union(own)), convs.select("conv_id")


def merged(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One conversation per distinct sequence (rep, weight, len), and (rep, conv_id) of those that stand for several."""
    digest = turns.groupBy("conv_id").agg(F.count("*").alias("len"), F.bit_xor(F.xxhash64("pos", "turn_id")).alias("x1"),
                                          F.bit_xor(F.xxhash64(F.lit(1), "turn_id", "pos")).alias("x2"))
    key = ["len", "x1", "x2"]
    full = written(convs.join(digest, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in key]))
    reps = written(full.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")))
    return reps.select("rep", "weight", "len"), full.join(reps.where("weight > 1"), key).select("rep", "conv_id")


def _sweep(top: dict, suffixes: list[dict]) -> list[tuple]:
    """The nodes of one container from its suffixes in order; the first one is its head."""
    parent, chars, n, conv, ends, depth = [-1], [top["chars"]], [0], [None], [None], [top["depth"]]
    path, before = [0], []
    for row in suffixes:
        ids = row["ids"]
        common = 0
        while common < min(len(ids), len(before)) and ids[common] == before[common]:
            common += 1
        del path[common + 1:]
        for k in range(common, len(ids)):
            parent.append(path[-1])
            path.append(len(n))
            chars.append(row["lengths"][k])
            depth.append(top["depth"] + k + 1)
            n.append(0)
            conv.append(None)
            ends.append(None)
        for node in path:
            n[node] += row["weight"]
            conv[node] = row["rep"] if conv[node] is None else min(conv[node], row["rep"])
        ends[path[-1]] = row["rep"]
        before = ids
    children, leaves, saved = [0] * len(n), [0] * len(n), [0] * len(n)
    for node in reversed(range(len(n))):
        leaves[node] = leaves[node] or 1
        saved[node] += (n[node] - 1) * chars[node]
        if node:
            up = parent[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    rows = []
    for node in range(len(n)):
        keys = (top["p1"], top["p2"], True) if node == 0 else (None, None, False)
        above = top["parent_conv"] if node == 0 else conv[parent[node]]
        rows.append((*keys, conv[node], depth[node], above, n[node], children[node], leaves[node], saved[node], ends[node]))
    return rows


def _sweep_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A container's rows follow each other, in the order of their ids; at most one container is held."""
    schema = pa.schema([(c, pa.bool_() if c == "top" else pa.int64()) for c in NODE_COLUMNS])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, type=f.type) for column, f in zip(zip(*rows), schema)], schema=schema)

    held: list[dict] = []
    for received in batches:
        for row in received.to_pylist():
            if held and (row["h1"], row["h2"]) != (held[0]["h1"], held[0]["h2"]):
                yield batch(_sweep(held[0], held))
                held = []
            held.append(row)
    if held:
        yield batch(_sweep(held[0], held))


def _sweep_all(containers: DataFrame, steps: DataFrame) -> DataFrame:
    """The nodes of all containers within the bound."""
    own = containers.select("rep", "depth")
    rest = steps.join(own, "rep").where("pos >= depth").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "chars"))).alias("rest"))
    rows = containers.join(rest, "rep", "left").select(
        *HEAD, "p1", "p2", "parent_conv", "depth", "chars", "rep", "weight",
        *[F.coalesce(F.col(f"rest.{c}"), F.array().cast(f"array<{kind}>")).alias(name)
          for c, kind, name in (("turn_id", "binary", "ids"), ("chars", "long", "lengths"))])
    return rows.repartition(*HEAD).sortWithinPartitions(*HEAD, "ids").mapInArrow(_sweep_shard, NODES)


def _chains(giants: DataFrame, steps: DataFrame, block: int) -> DataFrame:
    """The nodes of single suffixes above the bound: one row per turn, and sums of later turns by blocks."""
    below = steps.join(giants.drop("chars"), "rep").where("pos >= depth").select(*giants.columns, (F.col("pos") + 1).alias("at"))
    rows = giants.withColumn("at", F.col("depth")).union(below).withColumn("block", F.floor(F.col("at") / block))
    later = Window.partitionBy("rep").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    sums = rows.groupBy("rep", "block").agg(F.sum("chars").alias("own")).select("rep", "block", F.coalesce(F.sum("own").over(later), F.lit(0)).alias("after"))
    inside = Window.partitionBy("rep", "block").orderBy("at").rowsBetween(0, Window.unboundedFollowing)
    top, last = F.col("at") == F.col("depth"), F.col("at") == F.col("len")
    return rows.join(sums, ["rep", "block"]).withColumn("chars_on", F.sum("chars").over(inside) + F.col("after")).select(
        *[F.when(top, F.col(c)).alias(c) for c in ("p1", "p2")], top.alias("top"), F.col("rep").alias("conv_id"), F.col("at").alias("depth"),
        F.when(top, F.col("parent_conv")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * F.col("chars_on")).alias("saved_tokens"), F.when(last, F.col("rep")).alias("end_rep"))


def _burst(reps: DataFrame, steps: DataFrame, bound: int) -> tuple[DataFrame, list[DataFrame]]:
    """The suffixes at rest, each with its container and depth, and the burst heads of every depth."""
    nothing = F.lit(None).cast("long")
    # written, so that the root's key is a column and not a literal: a join on literals has no key to be dealt out by
    state = written(reps.select("rep", "weight", "len", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"),
                                nothing.alias("p1"), nothing.alias("p2"), nothing.alias("parent_conv"), F.lit(0).cast("long").alias("chars")))
    resting, heads, depth = [], [], 0
    while True:
        stats = state.groupBy(*HEAD).agg(F.count("*").alias("n_reps"), F.sum("weight").alias("n_convs"), F.min("rep").alias("conv"),
                                         F.sum(F.col("len") - depth).alias("turns"))
        bursts = (F.col("n_reps") > 1) & (F.col("turns") > bound)
        marked = written(state.join(stats, HEAD).withColumns({"bursts": bursts, "depth": F.lit(depth).cast("long")}))
        resting.append(marked.where("NOT bursts"))
        if not marked.where("bursts").take(1):
            return reduce(DataFrame.union, resting), heads
        burst = marked.where("bursts")
        heads.append(written(burst.groupBy(*HEAD).agg(
            *[F.first(c).alias(c) for c in ("p1", "p2", "parent_conv", "conv", "n_convs", "chars", "depth")],
            F.max(F.when(F.col("len") == depth, F.col("rep"))).alias("end_rep"))))
        on = burst.drop("chars").join(steps.where(F.col("pos") == depth), "rep")
        state = written(on.select("rep", "weight", "len", F.xxhash64(*HEAD, "turn_id").alias("h1"), F.xxhash64(F.lit(1), "turn_id", *HEAD).alias("h2"),
                                  F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv").alias("parent_conv"), "chars"))
        depth += 1


def _folded_heads(nodes: DataFrame, heads: list[DataFrame]) -> list[DataFrame]:
    """The burst heads as nodes: sums over their children, from the deepest heads up."""
    folded: list[DataFrame] = []
    tops = nodes.where("top")
    for level in reversed(heads):
        children = reduce(DataFrame.union, [tops, *folded[-1:]])
        sums = children.groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        folded.append(written(level.join(sums, HEAD).select(
            "p1", "p2", F.lit(True).alias("top"), F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
            "n_children", "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), "end_rep")))
    return folded


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per rep over its texts, which follow each other in order."""
    rep, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for row_rep, text in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
            if row_rep != rep:
                if digest is not None:
                    done.append((rep, digest.hexdigest()))
                rep, digest = row_rep, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["end_rep", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["end_rep", "ends"])


def ends_digests(members: DataFrame, block: int = ID_BLOCK) -> DataFrame:
    """(end_rep, ends): SHA-256 of the comma-joined, ascending ids of each rep."""
    blocks = members.groupBy("rep", F.floor(F.col("conv_id") / block).alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return blocks.repartition("rep").sortWithinPartitions("rep", "block").select("rep", "ids").mapInArrow(_hash_blocks, "end_rep long, ends string")


def trie_nodes(conversations: DataFrame, bound: int = CONTAINER_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    turns, convs = rebuilt(ordered_turns(conversations))
    reps, members = merged(turns, convs)
    steps = written(turns.join(reps.select("rep"), F.col("conv_id") == F.col("rep")).select("rep", "pos", "turn_id", "chars"))
    resting, heads = _burst(reps, steps, bound)
    giant = F.col("turns") > bound
    nodes = _sweep_all(resting.where(~giant), steps)
    giants = resting.where(giant).select("rep", "weight", "len", "depth", "p1", "p2", "parent_conv", "chars")
    nodes = written(nodes.union(_chains(giants, steps, bound)))
    every = reduce(DataFrame.union, [nodes, *_folded_heads(nodes, heads)])
    lone = F.when(F.col("end_rep").isNull(), F.lit("")).otherwise(F.col("end_rep").cast("string"))
    return every.join(ends_digests(members), "end_rep", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(lone, 256)).alias("ends_sha256"))
