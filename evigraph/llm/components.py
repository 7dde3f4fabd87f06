"""Connected components of an undirected graph of any size, by alternating stars.

Each pass hangs the larger neighbours of a node on its smallest one, then the
smaller ones. Minima are partial aggregates, and the joins on a node are plain
equi joins that Spark can split, so a node with very many neighbours never
meets in one task. The edges of each pass are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import written

EDGES_OF_A_TASK = 5_000


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: every neighbour of a node above it is hung on the node's smallest one."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("n")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: the neighbours of a node below it, and the node, are hung on the smallest one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    hung = edges.join(least, F.col("u") == F.col("n")).where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); the component is its smallest node. Loops and repeats are allowed."""
    state = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        figures = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(figures) == before:
            break
        before = tuple(figures)
        tasks = -(-before[0] // EDGES_OF_A_TASK) or 1  # a table of few edges is few files, whatever the number of shuffle partitions
        state = written(_small_star(written(_large_star(state).coalesce(tasks))).coalesce(tasks))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
