"""Reviews, upserts, deletion cascades and removal of what lost its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.session import cut_lineage

REVIEWABLE = ("unreviewed", "needs_review")


def apply_reviews(relations: DataFrame, reviews: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(relations, conflicts): the first approve / reject of an open relation stands.

    ``reviews(review_id, relation_id, decision, <order…>)``.
    """
    valid = reviews.filter(F.col("decision").isin("approved", "rejected"))
    first = valid.groupBy("relation_id").agg(F.min(F.struct(*order, "review_id", "decision")).alias("f")).select(
        F.col("relation_id").alias("id"), F.col("f.review_id").alias("_review"), F.col("f.decision").alias("_decision"))
    joined = relations.join(first, "id", "left").withColumn(
        "_applied", F.col("review_state").isin(*REVIEWABLE) & F.col("_decision").isNotNull())
    done = joined.withColumn("review_state", F.when(F.col("_applied"), F.col("_decision")).otherwise(F.col("review_state")))
    used = joined.filter("_applied").select(F.col("_review").alias("review_id"))
    return done.drop("_review", "_decision", "_applied"), reviews.join(used, "review_id", "left_anti")


def insert_absent(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows stay; ids seen for the first time are added once."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    rest = [c for c in incoming.columns if c != key]
    one = fresh.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return stored.unionByName(one.select(stored.columns))


def update_on_conflict(stored: DataFrame, incoming: DataFrame, updates: list[str], order: str, key: str = "id") -> DataFrame:
    """Latest incoming values replace ``updates`` of existing rows; new ids are added."""
    rest = [c for c in incoming.columns if c not in (key, order)]
    latest = incoming.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    new = latest.select(key, *[F.col(f"_r.{c}").alias(f"_{c}") for c in rest], F.lit(True).alias("_hit"))
    merged = stored.withColumn("_old", F.lit(True)).join(new, key, "full")

    def pick(c: str) -> Column:
        if c == key or c not in rest:
            return F.col(c)
        if c in updates:
            return F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)

    return merged.select(*[pick(c) for c in stored.columns])


def collect_garbage(
    removed_documents: DataFrame, entities: DataFrame, relations: DataFrame, evidence: DataFrame,
    aliases: DataFrame, merges: DataFrame, alias_evidence: DataFrame | None = None, cited_only: bool = False,
) -> dict[str, DataFrame]:
    """Ids to delete when documents go: evidence, aliases, relations, entities and merge records.

    Endpoints of touched relations are candidates too, taken before the relations
    are dropped. An entity in merge history with a surviving partner is kept.
    ``cited_only`` leaves relations without any evidence out of the graph, so
    that they hold no entity.
    """
    removed = removed_documents.select("document_id").distinct().withColumn("_gone", F.lit(True))
    # Written once: every mark below is read off the ids and the flag, so the evidence is derived and joined a single time.
    marked = cut_lineage(evidence.select("id", "document_id", "relation_id", "entity_id").join(removed, "document_id", "left").select(
        "id", "relation_id", "entity_id", F.coalesce("_gone", F.lit(False)).alias("_gone")))

    def subjects(column: str) -> DataFrame:
        """Per cited subject: did it lose evidence, does any remain. One pass, partially aggregated."""
        return marked.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("id")).agg(
            F.bool_or("_gone").alias("_lost"), F.bool_or(~F.col("_gone")).alias("_left"))

    gone = marked.filter("_gone")
    state = relations.select("id", "source_entity_id", "target_entity_id").join(subjects("relation_id"), "id", "inner" if cited_only else "left").withColumn(
        "_lost", F.coalesce("_lost", F.lit(False))).withColumn("_dead", F.col("_lost") & ~F.coalesce("_left", F.lit(False)))
    state = cut_lineage(state.drop("_left"))
    ends = F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")
    # Only touched relations and the ends of every relation matter from here on.
    by_relation = state.select(ends, "_lost", (~F.col("_dead")).alias("_left"))
    direct = subjects("entity_id")
    per_entity = by_relation.unionByName(direct.select("id", "_lost", "_left")).groupBy("id").agg(
        F.bool_or("_lost").alias("_lost"), F.bool_or("_left").alias("_left"))
    dead_relations = state.filter("_dead").select("id")
    unsupported = cut_lineage(
        per_entity.filter(F.col("_lost") & ~F.col("_left")).select("id").join(entities.select("id"), "id", "left_semi"))

    flags = unsupported.select("id", F.lit(True).alias("_u"))
    sides = (
        merges.join(flags.withColumnsRenamed({"id": "source_entity_id", "_u": "_s"}), "source_entity_id", "left")
        .join(flags.withColumnsRenamed({"id": "target_entity_id", "_u": "_t"}), "target_entity_id", "left")
    )
    survivors = sides.filter(F.col("_s").isNotNull() != F.col("_t").isNotNull()).select(ends).distinct()
    dead_entities = unsupported.join(survivors, "id", "left_anti")
    dead_merges = sides.filter(F.col("_s") & F.col("_t")).select("source_entity_id", "target_entity_id")

    of_dead = aliases.join(dead_entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    dead_aliases = of_dead.select("entity_id", "alias")
    if alias_evidence is not None:
        lost = direct.filter("_lost").select(F.col("id").alias("entity_id"))
        remaining = marked.filter(~F.col("_gone")).select(F.col("id").alias("evidence_id"))
        uncited = aliases.join(lost, "entity_id", "left_semi").join(
            alias_evidence.join(remaining, "evidence_id", "left_semi"), "alias_id", "left_anti")
        dead_aliases = dead_aliases.unionByName(uncited.select("entity_id", "alias")).distinct()
    return {
        "evidence": gone.select("id"), "relations": dead_relations, "entities": dead_entities,
        "aliases": dead_aliases, "merges": dead_merges,
    }


def delete_by_key(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return table.join(removed.select(key).distinct(), key, "left_anti")


def deletion_audit(tables: dict[str, DataFrame], removed: DataFrame, key: str, at: Column) -> DataFrame:
    """One row per table and removed key with the number of rows dropped."""
    parts = [
        df.join(removed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("rows_removed"))
        .select(F.lit(name).alias("table_name"), key, "rows_removed", at.alias("removed_at"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def referenced_entities(relations: DataFrame) -> DataFrame:
    """Ids used as a source or a target."""
    return relations.select(F.col("source_entity_id").alias("id")).unionByName(
        relations.select(F.col("target_entity_id").alias("id"))).distinct()
