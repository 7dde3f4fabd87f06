"""Scope, time and support predicates over entities, relations and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.session import cut_lineage


def normalize_dataset_id(dataset_id: Column) -> Column:
    return F.when(dataset_id.startswith("ds_"), dataset_id).otherwise(F.concat(F.lit("ds_"), dataset_id))


def in_scope(project_id: str, dataset_id: str | None = None) -> Column:
    """Caller's project, and dataset with its prefix added when missing."""
    keep = F.col("project_id") == F.lit(project_id)
    if dataset_id is not None:
        full = dataset_id if dataset_id.startswith("ds_") else f"ds_{dataset_id}"
        keep = keep & (F.col("dataset_id") == F.lit(full))
    return keep


def temporal_filter(as_of: Column | None = None, include_history: bool = False) -> Column:
    """Valid now, valid at ``as_of``, or everything."""
    if include_history:
        return F.lit(True)
    if as_of is not None:
        return (F.col("valid_from") <= as_of) & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of))
    return F.col("valid_until").isNull() & F.col("superseded_by").isNull()


def supported_relations(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Not rejected, and approved or cited. Evidence shrinks to distinct ids before the join."""
    cited = (
        evidence.filter(F.col("relation_id").isNotNull())
        .select(F.col("relation_id").alias("id")).distinct()
        .withColumn("_cited", F.lit(True))
    )
    return (
        relations.filter(F.col("review_state") != "rejected")
        .join(cited, "id", "left")
        .filter((F.col("review_state") == "approved") | F.col("_cited"))
        .drop("_cited")
    )


def supported_entity_ids(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Ids backed by direct evidence or by a cited, non-rejected relation endpoint."""
    direct = evidence.filter(F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("id"))
    cited = evidence.filter(F.col("relation_id").isNotNull()).select(F.col("relation_id").alias("id")).distinct()
    endpoints = (
        relations.filter(F.col("review_state") != "rejected")
        .join(cited, "id", "left_semi")
        .select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id"))
    )
    return direct.unionByName(endpoints).distinct()


def supported_entities(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Not rejected, and approved or backed by evidence."""
    backed = supported_entity_ids(entities, relations, evidence).withColumn("_backed", F.lit(True))
    return (
        entities.filter(F.col("review_state") != "rejected")
        .join(backed, "id", "left")
        .filter((F.col("review_state") == "approved") | F.col("_backed"))
        .drop("_backed")
    )


def supported_graph(
    entities: DataFrame, relations: DataFrame, evidence: DataFrame, columns: tuple[str, ...] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Supported entities and relations for jobs that need both.

    Relations are marked as cited once and written to the shared folder, so the
    evidence table, the largest one, is read and reduced a single time. Only
    supported ones are written, as others back no entity either. ``columns``
    names what the job needs of a relation beside its id and ends; without it
    all columns are shuffled and written.
    """
    if columns is not None:
        needed = {"id", "source_entity_id", "target_entity_id", "review_state", *columns}
        relations = relations.select(*[c for c in relations.columns if c in needed])
    cited = (
        evidence.filter(F.col("relation_id").isNotNull())
        .select(F.col("relation_id").alias("id")).distinct().withColumn("_cited", F.lit(True))
    )
    marked = relations.filter(F.col("review_state") != "rejected").join(cited, "id", "left")
    marked = marked.withColumn("_cited", F.coalesce("_cited", F.lit(False)))
    marked = cut_lineage(marked.filter((F.col("review_state") == "approved") | F.col("_cited")))
    endpoints = marked.filter("_cited").select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id"))
    if "entity_id" in evidence.columns:
        endpoints = endpoints.unionByName(
            evidence.filter(F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("id")))
    backed = endpoints.distinct().withColumn("_backed", F.lit(True))
    people = entities.filter(F.col("review_state") != "rejected").join(backed, "id", "left").filter(
        (F.col("review_state") == "approved") | F.col("_backed")).drop("_backed")
    return cut_lineage(people), marked.drop("_cited")


def current_evidence(evidence: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Evidence whose entity or relation is current."""
    now = temporal_filter()
    live_entities = entities.filter(now).select(F.col("id").alias("entity_id"))
    live_relations = relations.filter(now).select(F.col("id").alias("relation_id"))
    by_entity = evidence.filter(F.col("entity_id").isNotNull()).join(live_entities, "entity_id", "left_semi")
    by_relation = (
        evidence.filter(F.col("entity_id").isNull() & F.col("relation_id").isNotNull())
        .join(live_relations, "relation_id", "left_semi")
    )
    return by_entity.select(evidence.columns).unionByName(by_relation.select(evidence.columns))


# Entity types that carry little meaning on their own.
LOW_SIGNAL_TYPES = (
    "access_date", "accepted_date", "article_number", "contract", "doi", "iteration_limit",
    "journal_volume", "numeric value", "publication_date", "publication_year", "received_date",
    "revised_date", "sample size", "value",
)
# Fixed value: names made only of digits and number punctuation.
NUMERIC_NAME = r"^[\d\s.,%×x/–\-]+$"


def low_signal(name: Column, entity_type: Column) -> Column:
    kind = F.lower(F.trim(entity_type))
    return (
        kind.isin(*LOW_SIGNAL_TYPES)
        | kind.endswith("_date")
        | kind.endswith("_year")
        | F.lower(F.trim(name)).rlike(NUMERIC_NAME)
    )


# Display bucket of each known entity type.
TYPE_BUCKETS = {
    "person": ("person", "people", "author", "researcher"),
    "org": ("organization", "org", "organisation", "company", "institution"),
    "tech": ("technology", "tech", "tool", "framework", "system"),
    "concept": ("concept", "topic", "method", "technique", "algorithm"),
    "document": ("document", "paper", "article", "publication", "file"),
}


def type_bucket(entity_type: Column) -> Column:
    kind = F.lower(F.trim(entity_type))
    out = F.lit("unknown")
    for bucket, names in TYPE_BUCKETS.items():
        out = F.when(kind.isin(*names), bucket).otherwise(out)
    return out


# Document states that no longer change.
TERMINAL_STATUSES = ("indexed", "failed", "cancelled", "stale", "delete_failed", "storage_failed")


def effective_status(status: Column, graph_stage: Column) -> Column:
    """An indexed document whose graph is unfinished still shows as persisting or failed."""
    unfinished = (status == "indexed") & (F.coalesce(graph_stage, F.lit("")) != "complete")
    return (
        F.when(unfinished & (graph_stage == "failed"), "failed")
        .when(unfinished, "persisting")
        .otherwise(status)
    )


def source_location(metadata_json: Column) -> Column:
    """Integer page, record and part numbers kept from chunk metadata; null when none."""
    doc = F.try_parse_json(metadata_json)
    # A quoted number is not a location, so the JSON type is checked before the cast.
    fields = [
        F.when(
            F.schema_of_variant(F.try_variant_get(doc, f"$.{k}", "variant")) == "BIGINT",
            F.try_variant_get(doc, f"$.{k}", "bigint"),
        ).alias(k)
        for k in ("page_number", "record_number", "segment_part")
    ]
    location = F.struct(*fields)
    return F.when(F.coalesce(*[location[k] for k in ("page_number", "record_number", "segment_part")]).isNotNull(), location)
