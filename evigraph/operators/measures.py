"""Degrees, weights, density, digests and community statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.scalars import hash_number, set_digest


def endpoint_degree(relations: DataFrame) -> DataFrame:
    """Times an entity is a source or a target; parallel relations count each."""
    return (
        relations.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id"))
        .groupBy("id").agg(F.count("*").alias("degree"))
    )


def density(relation_count: Column, entity_count: Column) -> Column:
    pairs = entity_count.cast("double") * (entity_count - 1)
    return F.when(entity_count >= 2, 2.0 * relation_count / F.nullif(pairs, F.lit(0.0))).otherwise(F.lit(0.0))


def fold_edges(relations: DataFrame, src: str = "source_entity_id", dst: str = "target_entity_id",
               weight: str = "confidence") -> DataFrame:
    """Undirected edges ``a < b`` with the summed weight of parallel and reverse relations."""
    return (
        relations.groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
        .agg(F.sum(weight).alias("weight"))
    )


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id"), "weight")


def node_metrics(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct-neighbour degree, weighted degree and share of all weight; isolated nodes stay."""
    per_node = _ends(edges).groupBy("id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))
    totals = entities.agg(F.count("*").alias("_n")).crossJoin(edges.agg(F.sum("weight").alias("_w")))
    # ``totals`` is one aggregate row.
    return (
        entities.select("id").join(per_node, "id", "left")
        .select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"),
                F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))
        .crossJoin(F.broadcast(totals))
        .withColumn("importance", F.when(F.coalesce("_w", F.lit(0.0)) > 0, F.col("weighted_degree") / (2 * F.col("_w")))
                    .otherwise(1.0 / F.col("_n")))
        .drop("_n", "_w")
    )


def quotient(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between communities; edges inside one community are dropped."""
    m = members.select("entity_id", "community_id")
    crossing = (
        edges.join(m.select(F.col("entity_id").alias("a"), F.col("community_id").alias("ca")), "a")
        .join(m.select(F.col("entity_id").alias("b"), F.col("community_id").alias("cb")), "b")
        .filter(F.col("ca") != F.col("cb"))
    )
    return fold_edges(crossing, "ca", "cb", "weight")


def community_stats(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Size, internal / external edges, density, importance and parent per level and community.

    ``members(entity_id, level, community_id)`` holds all levels; both endpoint
    joins carry the levels along, so one pass serves the hierarchy.
    """
    sides = members.select("entity_id", "level", "community_id")
    placed = (
        edges.join(sides.select(F.col("entity_id").alias("a"), "level", F.col("community_id").alias("ca")), "a")
        .join(sides.select(F.col("entity_id").alias("b"), "level", F.col("community_id").alias("cb")), ["b", "level"])
        .groupBy("level", "ca", "cb").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    )
    touching = placed.select(
        "level", F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community_id"),
        F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0).alias("internal"),
        F.when(F.col("ca") != F.col("cb"), F.col("n")).otherwise(0).alias("external"), "w",
    )
    sums = touching.groupBy("level", "community_id").agg(
        F.sum("internal").alias("internal_edges"), F.sum("external").alias("external_edges"), F.sum("w").alias("_w"))
    sizes = members.groupBy("level", "community_id").agg(
        F.count("*").alias("entity_count"), F.min("entity_id").alias("_first"))
    parents = members.select(
        F.col("entity_id").alias("_first"), (F.col("level") - 1).alias("level"), F.col("community_id").alias("parent_id"))
    total = edges.agg(F.sum("weight").alias("_total"))
    size = F.col("entity_count")
    return (
        sizes.join(sums, ["level", "community_id"], "left").join(parents, ["_first", "level"], "left")
        .crossJoin(F.broadcast(total))
        .select(
            "level", "community_id", "parent_id", "entity_count",
            F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"),
            F.coalesce("external_edges", F.lit(0)).alias("external_edges"),
            density(F.coalesce("internal_edges", F.lit(0)), size).alias("density"),
            F.when(F.coalesce("_total", F.lit(0.0)) > 0, F.coalesce("_w", F.lit(0.0)) / (2 * F.col("_total")))
            .otherwise(0.0).alias("importance"),
        )
    )


def community_ids(members: DataFrame, version: str) -> DataFrame:
    """Id of each group from its level and member set; no group is gathered."""
    digest = members.groupBy("level", "community_id").agg(
        set_digest(F.col("entity_id")).alias("_set"), F.min("entity_id").alias("_first"))
    return digest.select(
        "level", "community_id",
        F.substring(F.sha2(F.concat_ws(":", F.lit(version), F.col("level").cast("string"), "_first", "_set"), 256), 1, 32)
        .alias("stable_id"),
    )


def graph_digest(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: counts and a digest that changes when any supported row changes."""
    rows = entities.select(F.concat(F.lit("e:"), "id").alias("row")).unionByName(
        relations.select(F.concat_ws(
            ":", F.lit("r"), "source_entity_id", "target_entity_id",
            F.round(F.col("confidence") * 10000).cast("bigint").cast("string")).alias("row")))
    is_entity = F.col("row").startswith("e:")
    return rows.agg(
        F.count(F.when(is_entity, 1)).alias("entity_count"),
        F.count(F.when(~is_entity, 1)).alias("relation_count"),
        set_digest(F.col("row")).alias("snapshot_hash"),
    )
