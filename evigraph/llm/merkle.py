"""Merkle manifest of a dataset, built by a butterfly exchange.

Rows become leaves; per source they ascend by id and every ``FANOUT``
consecutive nodes become one digest, level by level, up to the source's
subroot; the subroots, ordered by source, go on likewise up to the root.

The leaves of a source are cut into aligned blocks of ``FANOUT ** LOCAL`` (4 096),
which are the partitions of the exchange: a block hashes its own lower levels.
Then, round by round, the up to 16 neighbouring subtrees of a run swap their
roots: a block of one subtree sends its node to the block of the same place in
each other subtree, and, where the other subtree has more blocks, to those that
repeat that place. Every block so receives the whole run, keeps it as a step of
its proof and hashes the parent itself, redundantly, so after the last round
each block holds its path to the root and nothing is handed down. A message
group is one run (16 digests at most). The same rounds go on over the sources.
One row per block (4 096 documents) takes part, so a hot source is many blocks;
a round sends at most one digest per block and sibling.

Cases: every row is a leaf, repeated rows too; null fields are written ``-``
and differ from empty ones; rows of equal (source, id) are ordered by leaf; a
null id comes first in its source, a null source first of all; a source with
one leaf has that leaf as subroot, one source alone gives its subroot as root;
an empty table gives no rows; other columns, whatever their names, are ignored.
Very long texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import ascii_lower, written
from evigraph.llm.numbering import group_runs, placed, sorted_parts

FANOUT = 16
LOCAL = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MODULUS = 5
PATH_TYPE = "array<struct<nodes: array<string>, slot: int>>"


def hash_text(text: Column) -> Column:
    return F.sha2(text, 256)


def hash_run(nodes: Column) -> Column:
    """The parent of a run of nodes."""
    return hash_text(F.array_join(nodes, ""))


def leaf_hash(values: list[Column]) -> Column:
    """Every value as its UTF-8 byte count, a colon and itself, ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return hash_text(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def siblings(step: Column) -> Column:
    """The nodes of a proof step beside the proven one."""
    nodes, slot = step["nodes"], step["slot"]
    return F.concat(F.slice(nodes, F.lit(1), slot), F.slice(nodes, slot + 2, F.size(nodes)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    def step(node: Column, s: Column) -> Column:
        nodes, slot = s["nodes"], s["slot"]
        return hash_run(F.concat(F.slice(nodes, F.lit(1), slot), F.array(node), F.slice(nodes, slot + 2, F.size(nodes))))

    return F.aggregate(path, leaf, step)


def proof_hash(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return hash_text(F.array_join(F.transform(path, lambda s: F.array_join(siblings(s), "")), ""))


def _levels(n: int) -> int:
    """Rounds that leave one of ``n`` nodes."""
    levels = 0
    while FANOUT ** levels < n:
        levels += 1
    return levels


def _parents(nodes: Column) -> Column:
    def hashed(bound: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / FANOUT))
        return F.transform(starts, lambda i: hash_run(F.slice(bound, (i * FANOUT + 1).cast("int"), FANOUT)))

    # An outer one-element transform binds the level, which the inner function would otherwise compute anew for every run.
    return F.transform(F.array(nodes), hashed)[0]


def _local_levels(leaves: Column, several: Column, local: int) -> list[tuple[Column, Column]]:
    """(nodes, counts) of the levels inside a block; a level counts while nodes remain to be joined, here or in other blocks."""
    levels = [leaves]
    for _ in range(local - 1):
        levels.append(_parents(levels[-1]))
    return [(nodes, several | (F.size(nodes) > 1)) for nodes in levels]


def _source_table(runs: DataFrame, size: int) -> DataFrame:
    """(source, s, first_block, n_blocks): rank of each source and the number of blocks of ``size`` leaves before it, from sums per partition."""
    total = F.sum("n").over(Window.partitionBy("source"))
    heads = runs.withColumn("n_blocks", F.ceil(total / size).cast("long")).where("before = 0").select("part", "first", "source", "n_blocks")
    parts = heads.groupBy("part").agg(F.count("*").alias("c"), F.sum("n_blocks").alias("b"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = parts.select(F.col("part").alias("at"), *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ("c", "b")])
    inside = Window.partitionBy("part").orderBy("first")
    before = F.coalesce(F.sum("n_blocks").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return heads.join(parts, heads["part"] == parts["at"]).select(
        "source", (F.col("c") + F.row_number().over(inside) - 1).alias("s"), (F.col("b") + before).alias("first_block"), "n_blocks")


def _with_bounds(sources: DataFrame, levels: int) -> DataFrame:
    """``sources`` with ``bounds``: per level, the first blocks of the subtrees in the source's run and the end of the run."""
    out = sources.withColumn("bounds", F.array().cast("array<array<long>>"))
    for k in range(levels):
        unit, run = FANOUT ** k, FANOUT ** (k + 1)
        units = sources.groupBy(F.floor(F.col("s") / unit).alias("q")).agg(
            F.min("first_block").alias("start"), F.max(F.col("first_block") + F.col("n_blocks")).alias("end"))
        runs = units.groupBy(F.floor(F.col("q") / FANOUT).alias("run")).agg(
            F.concat(F.sort_array(F.collect_list("start")), F.array(F.max("end"))).alias("b"))
        out = out.join(runs, F.floor(out["s"] / run) == runs["run"]).withColumn("bounds", F.concat("bounds", F.array("b"))).drop("run", "b")
    return out


def _swap(state: DataFrame, bounds: Column, slot: Column, active: Column) -> DataFrame:
    """One round: the subtrees of a run, which begin at the blocks ``bounds``, swap their roots."""
    state = state.withColumns({"_b": bounds, "_slot": slot.cast("int"), "_active": active})
    b, own = F.col("_b"), F.col("_slot")
    low, size = F.col("block") - F.get(b, own), F.get(b, own + 1) - F.get(b, own)
    none = F.array().cast("array<long>")

    def receivers(q: Column) -> Column:
        first, end = F.get(b, q) + low, F.get(b, q + 1)
        return F.when(q == own, F.array("block")).when(first < end, F.sequence(first, end - 1, size)).otherwise(none)

    to = F.when(F.col("_active"), F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), receivers))).otherwise(F.array("block"))
    sent = state.withColumn("to", F.explode(to))
    kept = F.when(F.col("to") == F.col("block"), F.struct(*[c for c in state.columns if c not in ("_b", "block")]))
    got = sent.select("to", F.struct(F.col("_slot").alias("slot"), "node").alias("message"), kept.alias("own")).groupBy("to").agg(
        F.transform(F.array_sort(F.collect_list("message")), lambda m: m["node"]).alias("nodes"), F.first("own", ignorenulls=True).alias("own"))
    flat = got.select(F.col("to").alias("block"), "nodes", "own.*")
    step = F.array(F.struct("nodes", F.col("_slot").alias("slot")))
    return flat.select("block", *[c for c in state.columns if c not in ("block", "node", "path", "_b", "_slot", "_active")],
                       F.when(F.col("_active"), hash_run(F.col("nodes"))).otherwise(F.col("node")).alias("node"),
                       F.when(F.col("_active"), F.concat("path", step.cast(PATH_TYPE))).otherwise(F.col("path")).alias("path"))


def manifest(leaves: DataFrame, carry: tuple[str, ...] = (), local: int = LOCAL) -> DataFrame:
    """``doc_id``, ``leaf``, the columns ``carry``, ``path`` (its runs up to the root), ``subroot`` and ``root`` of every row.

    ``leaves`` has source, doc_id and leaf; every row of it is one leaf. A block is ``local`` (at least 1) levels high.
    """
    size = FANOUT ** local
    table = sorted_parts(leaves.select("source", "doc_id", "leaf", *carry), ["source"], ["doc_id", "leaf"])
    runs = written(group_runs(table, ["source"]))
    sources = written(_source_table(runs, size))
    n_sources, most = sources.agg(F.count("*"), F.max("n_blocks")).first()
    across = _levels(n_sources)
    of_source = sources.withColumnRenamed("source", "name")
    runs = runs.join(of_source, runs["source"].eqNullSafe(of_source["name"])).select(*runs.columns, "s", "first_block", "n_blocks")
    rows = placed(table, runs, ["source"], ["s", "first_block", "n_blocks"])

    member = F.struct((F.col("pos") % size).cast("int").alias("at"), "doc_id", "leaf", *carry)
    blocks = rows.groupBy((F.col("first_block") + F.floor(F.col("pos") / size)).alias("block")).agg(
        F.first("s").alias("s"), F.first("first_block").alias("first_block"), F.first("n_blocks").alias("n_blocks"),
        F.array_sort(F.collect_list(member)).alias("members"))
    blocks = written(blocks)

    several = F.col("n_blocks") > 1
    node = F.transform("members", lambda m: m["leaf"])
    for nodes, counts in _local_levels(node, several, local):
        node = F.when(counts, _parents(nodes)).otherwise(node)
    state = blocks.select("block", "s", "first_block", "n_blocks", node[0].alias("node"), F.array().cast(PATH_TYPE).alias("path"))
    for r in range(_levels(most or 0)):
        unit = FANOUT ** r
        p, width = F.floor((F.col("block") - F.col("first_block")) / unit), F.ceil(F.col("n_blocks") / unit)
        first = p - p % FANOUT
        starts = F.transform(F.sequence(first, F.least(first + FANOUT, width) - 1), lambda q: F.col("first_block") + q * unit)
        end = F.col("first_block") + F.least((first + FANOUT) * unit, F.col("n_blocks"))
        state = _swap(state, F.concat(starts, F.array(end)), p % FANOUT, width > 1)
    state = state.withColumn("subroot", F.col("node"))
    if across:
        edges = _with_bounds(sources.select("s", "first_block", "n_blocks"), across).select("s", "bounds")
        state = state.join(edges, "s")
    for k in range(across):
        state = _swap(state, F.col("bounds")[k], F.floor(F.col("s") / FANOUT ** k) % FANOUT, F.lit(True))
    upper = state.select("block", F.col("path").alias("upper"), "subroot", F.col("node").alias("root"))

    def steps(m: Column) -> Column:
        local = [F.when(counts, F.array(F.struct(
            F.slice(nodes, (F.floor(m["at"] / FANOUT ** (k + 1)) * FANOUT + 1).cast("int"), FANOUT).alias("nodes"),
            (F.floor(m["at"] / FANOUT ** k) % FANOUT).cast("int").alias("slot"))).cast(PATH_TYPE)).otherwise(F.array().cast(PATH_TYPE))
            for k, (nodes, counts) in enumerate(held)]
        return F.concat(*local, F.col("upper"))

    names = [f"level{k}" for k in range(local)]
    full = blocks.join(upper, "block").withColumn(names[0], F.transform("members", lambda m: m["leaf"]))
    for below, name in zip(names, names[1:]):
        full = full.withColumn(name, _parents(F.col(below)))
    held = [(F.col(n), several | (F.size(n) > 1)) for n in names]
    return full.select(F.inline(F.transform("members", lambda m: F.struct(
        *[m[c].alias(c) for c in ("doc_id", "leaf", *carry)], steps(m).alias("path"),
        F.col("subroot").alias("subroot"), F.col("root").alias("root")))))


def document_leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf of every document, and ``tampered``: the leaf with the text's A-Z in lower case where 5 divides the id's checksum."""
    def leaf(text: Column) -> Column:
        return leaf_hash([text if c == "text" else F.col(c) for c in FIELDS])

    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER_MODULUS == 0
    return docs.select("source", "doc_id", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(ascii_lower(F.col("text")))).alias("tampered"))


def verified(docs: DataFrame, local: int = LOCAL) -> DataFrame:
    """Leaf, roots and proof digest of every document, and whether its possibly tampered text still folds to the root."""
    out = manifest(document_leaves(docs), carry=("tampered",), local=local)
    out = out.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"),
                     fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))
