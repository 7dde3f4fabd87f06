"""Search, neighbours, citations, summary and explorer over entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.measures import density, endpoint_degree
from evigraph.operators.predicates import low_signal, source_location, supported_entities, supported_graph, supported_relations, temporal_filter
from evigraph.operators.ranking import top_n_per_group
from evigraph.operators.substring import containing
from evigraph.session import cut_lineage

MAX_CITATIONS = 20


def adjacency(relations: DataFrame) -> DataFrame:
    """Each relation seen from both ends: ``node``, ``other`` and the relation's columns."""
    ends = F.array(
        F.struct(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("other")),
        F.struct(F.col("target_entity_id").alias("node"), F.col("source_entity_id").alias("other")),
    )
    return relations.withColumn("_end", F.explode(ends)).select("*", "_end.node", "_end.other").drop("_end")


def citations(evidence: DataFrame, chunks: DataFrame, relations: DataFrame | None = None, limit: int = MAX_CITATIONS) -> DataFrame:
    """First ``limit`` cited quotes per relation in evidence-id order, with source location."""
    cited = evidence.filter(F.col("relation_id").isNotNull())
    first = top_n_per_group(  # ranked before the semi join, so that the map tasks cut the list of a hot relation
        cited.select("id", "relation_id", "document_id", "chunk_id", "quote"), ["relation_id"], [F.col("id")], limit, "rank")
    if relations is not None:
        first = first.join(relations.select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    # The place is read before the join: three numbers travel, not the metadata.
    places = chunks.select(F.col("id").alias("chunk_id"), source_location(F.col("metadata")).alias("source_location"))
    return first.join(places, "chunk_id")


def evidence_view(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """All relation evidence joined on (chunk, document, project, dataset)."""
    place = chunks.select(F.col("id").alias("chunk_id"), "document_id", "project_id", "dataset_id", "metadata")
    return (
        evidence.join(place, ["chunk_id", "document_id"])
        .withColumn("source_location", source_location(F.col("metadata"))).drop("metadata")
    )


def search_entities(
    terms: DataFrame, entities: DataFrame, aliases: DataFrame, relations: DataFrame, evidence: DataFrame,
    limit: int = 25, as_of: Column | None = None, include_history: bool = False,
) -> DataFrame:
    """Substring search on names and aliases for ``terms(query_id, q[, entity_type, as_of, include_history])``.

    Terms are a table like any other: an n-gram index brings them to the names
    that contain them. A query's own ``as_of`` and ``include_history`` go before
    the arguments, which hold for queries without them. A blank ``q`` finds nothing.
    """
    given = {c: F.col(c) for c in ("entity_type", "as_of", "include_history") if c in terms.columns}
    nothing = F.lit(None)
    asked = terms.select(
        "query_id", F.lower(F.trim("q")).alias("q"), F.lower(F.trim(given.get("entity_type", nothing.cast("string")))).alias("kind"),
        F.coalesce(given.get("as_of", nothing.cast("timestamp")), (as_of if as_of is not None else nothing).cast("timestamp")).alias("moment"),
        F.coalesce(given.get("include_history", nothing.cast("boolean")), F.lit(include_history)).alias("history"))
    live = supported_entities(entities, relations, evidence)
    names = live.select("id", F.lower("canonical_name").alias("text")).unionByName(
        aliases.select(F.col("entity_id").alias("id"), F.lower("alias").alias("text")))
    hits = containing(names, asked.select("query_id", F.col("q").alias("term")))
    valid = F.col("history") | F.when(F.col("moment").isNull(), temporal_filter()).otherwise(temporal_filter(F.col("moment")))
    found = hits.join(asked, "query_id").join(live, "id").filter(
        valid & (F.col("kind").isNull() | (F.lower("entity_type") == F.col("kind"))))
    exact = F.lower("canonical_name") == F.col("q")
    return top_n_per_group(
        found, ["query_id"],
        [exact.desc(), F.col("confidence").desc(), F.col("canonical_name"), F.col("id")], limit, "rank",
    ).select("query_id", "rank", "id", "canonical_name", "entity_type", "confidence")


def neighbours(
    roots: DataFrame, entities: DataFrame, relations: DataFrame, evidence: DataFrame,
    limit: int = 25, relation_types: tuple[str, ...] | None = None,
) -> DataFrame:
    """First ``limit`` current relations of each root, with the entity on the other side."""
    people, live = supported_graph(entities, relations, evidence, ("relation_type", "valid_until", "superseded_by"))
    people, live = people.filter(temporal_filter()), live.filter(temporal_filter())
    if relation_types:
        live = live.filter(F.col("relation_type").isin(*relation_types))
    # Ranked by the far ends' ids alone, which the map tasks cut; roots and names meet shown neighbours only.
    near = adjacency(live.select("id", "source_entity_id", "target_entity_id", "relation_type")).select("id", "node", "other", "relation_type")
    near = near.join(people.select(F.col("id").alias("other")), "other", "left_semi")
    shown = top_n_per_group(near, ["node"], [F.col("id")], limit, "rank").join(roots.select(F.col("root").alias("node")), "node", "left_semi")
    return shown.join(people.select(F.col("id").alias("other"), "canonical_name", "entity_type"), "other").select(
        F.col("node").alias("root"), "rank", F.col("id").alias("relation_id"), "relation_type",
        F.col("other").alias("entity_id"), "canonical_name", "entity_type")


def rank_entities(entities: DataFrame, degree: DataFrame, limit: int | None) -> DataFrame:
    """Degree order without low-signal names, which return only if nothing else is there."""
    low = low_signal(F.col("canonical_name"), F.col("entity_type"))
    scored = cut_lineage(
        entities.join(degree, "id", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))
        .withColumn("_low", low)
    )
    # One boolean row, so the fallback costs no window over all rows.
    useful = scored.agg(F.coalesce(F.max(~F.col("_low")), F.lit(False)).alias("_useful"))
    kept = scored.crossJoin(F.broadcast(useful)).filter(~F.col("_low") | ~F.col("_useful"))
    ordered = kept.orderBy(
        F.col("degree").desc(), "_low", F.lower("entity_type"), F.lower("canonical_name"), "id")
    return (ordered if limit is None else ordered.limit(limit)).drop("_low", "_useful")


def induced(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose two endpoints are both in ``nodes(id)``."""
    ids = nodes.select("id")
    return (
        relations.join(ids.withColumnRenamed("id", "source_entity_id"), "source_entity_id", "left_semi")
        .join(ids.withColumnRenamed("id", "target_entity_id"), "target_entity_id", "left_semi")
    )


def graph_summary(
    entities: DataFrame, relations: DataFrame, evidence: DataFrame, limit: int = 100,
    as_of: Column | None = None, include_history: bool = False, candidate_limit: int | None = None,
) -> DataFrame:
    """Ranked nodes with degree and the totals of the supported graph beside each."""
    keep = temporal_filter(as_of, include_history)
    people, links = supported_graph(entities, relations.withColumn("_keep", keep), evidence, ("_keep",))
    return ranked_summary(people.filter(keep), links.filter("_keep"), limit, candidate_limit)


def ranked_summary(people: DataFrame, links: DataFrame, limit: int = 100, candidate_limit: int | None = None) -> DataFrame:
    """``graph_summary`` of the supported entities and relations that a view keeps."""
    candidates = people if candidate_limit is None else people.orderBy("canonical_name", "id").limit(candidate_limit)
    totals = people.agg(F.count("*").alias("entity_count")).crossJoin(links.agg(F.count("*").alias("relation_count")))
    ranked = rank_entities(candidates, endpoint_degree(links), limit)
    return ranked.crossJoin(F.broadcast(totals)).select(
        "id", "canonical_name", "entity_type", "degree", "entity_count", "relation_count")


def with_citations(relations: DataFrame, evidence: DataFrame, chunks: DataFrame, limit: int = MAX_CITATIONS) -> DataFrame:
    """Relations with ``citations``, their first cited quotes and places, at most ``limit`` each, in order."""
    cited = citations(evidence, chunks, relations, limit).groupBy("relation_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("evidence_id"), "document_id", "chunk_id", "quote", "source_location"))).alias("citations"))
    kind = cited.schema["citations"].dataType
    return relations.join(cited, relations["id"] == cited["relation_id"], "left").drop("relation_id").withColumn(
        "citations", F.coalesce("citations", F.array().cast(kind)))


def neighbour_citations(near: DataFrame, evidence: DataFrame, chunks: DataFrame, limit: int = MAX_CITATIONS) -> DataFrame:
    """``neighbours`` with the citations of each relation; a relation that many roots share is looked up once."""
    near = cut_lineage(near)  # read twice: for its relations and for the rows
    found = with_citations(near.select(F.col("relation_id").alias("id")).distinct(), evidence, chunks, limit)
    return near.join(found.withColumnRenamed("id", "relation_id"), "relation_id")


def relations_among(
    nodes: DataFrame, relations: DataFrame, limit: int | None = None, as_of: Column | None = None, include_history: bool = True,
) -> DataFrame:
    """Relations between shown nodes, the first ``limit`` by id (a view's limit; none keeps all)."""
    kept = induced(relations.filter(temporal_filter(as_of, include_history)), nodes).select(
        "id", "source_entity_id", "target_entity_id", "relation_type", "confidence")
    return kept if limit is None else kept.orderBy("id").limit(limit)


def summary_relations(
    summary: DataFrame, relations: DataFrame, evidence: DataFrame, chunks: DataFrame, limit: int = 100,
    depth: int = 1, as_of: Column | None = None, include_history: bool = False, supported: bool = False,
) -> DataFrame:
    """The relations that a summary shows among its nodes, with citations; depth 0 shows none.

    The nodes are few, so relations between them and their evidence are looked
    up before support is judged: each filter below commutes with the others, and
    only the limit comes after all of them. ``supported`` says that ``relations``
    are supported ones already, as those the summary was made of.
    """
    nodes = cut_lineage(summary.select("id").distinct())
    open_ones = relations.filter((F.col("review_state") != "rejected") & temporal_filter(as_of, include_history))
    among = induced(open_ones if depth else open_ones.limit(0), nodes)
    among = cut_lineage(relations_among(nodes, among, limit, as_of, include_history) if supported else among)
    cited = evidence.select("id", "relation_id", "document_id", "chunk_id", "quote").join(
        among.select(F.col("id").alias("relation_id")), "relation_id", "left_semi")
    cited = cut_lineage(cited)
    if not supported:
        among = cut_lineage(relations_among(nodes, supported_relations(among, cited), limit, as_of, include_history))
    return with_citations(among, cited, chunks)


def explorer_nodes(entities: DataFrame, members: DataFrame, metrics: DataFrame, level: int = 0) -> DataFrame:
    """Entities with community and metrics; entities newer than the analytics run keep defaults."""
    at_level = members.filter(F.col("level") == level).select(F.col("entity_id").alias("id"), "community_id")
    return (
        entities.select("id", "canonical_name", "entity_type")
        .join(at_level, "id", "left").join(metrics, "id", "left")
        .select("id", "canonical_name", "entity_type", "community_id",
                F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"),
                F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"),
                F.coalesce("importance", F.lit(0.0)).alias("importance"))
    )


def most_important(nodes: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` explorer nodes of the largest weight, then the smallest id.

    Importance is the weight over one total, so both order alike. Weights are
    sums of doubles, whose last digits follow the order of addition; without the
    rounding these would decide between equal weights.
    """
    return nodes.orderBy(F.round("weighted_degree", 4).desc(), "id").limit(limit)


def explorer_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    one = entities.agg(F.count("*").alias("entity_count")).crossJoin(relations.agg(F.count("*").alias("relation_count")))
    return one.withColumn("density", density(F.col("relation_count"), F.col("entity_count")))


def child_ids(stats: DataFrame) -> DataFrame:
    """(level, community_id, child_id): the communities one level below, by their parent."""
    below = stats.filter(F.col("parent_id").isNotNull())
    return below.select((F.col("level") + 1).alias("level"), F.col("parent_id").alias("community_id"), F.col("community_id").alias("child_id"))


def children(stats: DataFrame) -> DataFrame:
    """Communities with the number of their children."""
    sizes = stats.filter(F.col("parent_id").isNotNull()).groupBy(
        F.col("level") + 1, "parent_id").agg(F.count("*").alias("child_count"))
    sizes = sizes.toDF("level", "community_id", "child_count")
    return stats.join(sizes, ["level", "community_id"], "left").withColumn(
        "child_count", F.coalesce("child_count", F.lit(0)).cast("bigint"))
