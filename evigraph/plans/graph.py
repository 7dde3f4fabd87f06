"""Registered graph queries: predicates, joins, aggregates, search, walks, explorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import measures as M
from evigraph.operators import predicates as P
from evigraph.operators import queries as Q
from evigraph.operators import ranking as R
from evigraph.operators.communities import latest_runs, stale
from evigraph.plans.inputs import Inputs, oracle
from evigraph.plans.registry import query
from evigraph.plans.sqlparts import ADJ, CURRENT, EDGES, GRAPH, LOW, NOW, SUPPORT, digest
from evigraph.session import cut_lineage


def evidence_of(t: Inputs) -> DataFrame:
    """Line-item evidence with the entity column the operators expect."""
    return t.g_evidence.withColumn("entity_id", F.lit(None).cast("string"))


# What the queries read of a current relation beside its id and ends.
LINK_COLUMNS = ("relation_type", "confidence", "valid_until", "superseded_by")


def current_graph(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """Supported and current entities and relations."""
    now = P.temporal_filter()
    people, links = P.supported_graph(t.g_entities, t.g_relations, t.g_evidence, LINK_COLUMNS)
    return people.filter(now), links.filter(now)


@query("f1_scope", oracle("SELECT id, canonical_name FROM g_entities WHERE project_id = 'p1' AND dataset_id = 'ds_tpch'", "g_entities"))
def f1_scope(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return t.g_entities.filter(P.in_scope("p1", "tpch")).select("id", "canonical_name")


@query("f1_dataset_prefix", """
SELECT doc_id, CASE WHEN starts_with(ds, 'ds_') THEN ds ELSE 'ds_' || ds END AS dataset_id FROM (
 SELECT doc_id, CASE WHEN lang = 'en' THEN 'ds_' || source ELSE source END AS ds FROM documents) d""")
def f1_prefix(spark: SparkSession, sf: str) -> DataFrame:
    docs = Inputs(spark, sf).documents
    raw = F.when(F.col("lang") == "en", F.concat(F.lit("ds_"), "source")).otherwise(F.col("source"))
    return docs.select("doc_id", P.normalize_dataset_id(raw).alias("dataset_id"))


@query("f3_temporal_current", oracle(f"SELECT id FROM g_entities WHERE {NOW}", "g_entities"))
def f3_current(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).g_entities.filter(P.temporal_filter()).select("id")


@query("f3_temporal_as_of", oracle(
    "SELECT id FROM g_relations WHERE valid_from <= TIMESTAMP '1997-06-01' "
    "AND (valid_until IS NULL OR valid_until > TIMESTAMP '1997-06-01')", "g_relations"))
def f3_as_of(spark: SparkSession, sf: str) -> DataFrame:
    when = F.lit("1997-06-01").cast("timestamp")
    return Inputs(spark, sf).g_relations.filter(P.temporal_filter(when)).select("id")


@query("f3_temporal_history", oracle("SELECT id FROM g_relations", "g_relations"))
def f3_history(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).g_relations.filter(P.temporal_filter(include_history=True)).select("id")


@query("f4_supported_relations", oracle("SELECT id, review_state FROM sr", *GRAPH, **SUPPORT))
def f4(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return P.supported_relations(t.g_relations, evidence_of(t)).select("id", "review_state")


@query("f5_supported_entities", oracle("SELECT id, review_state FROM se", *GRAPH, **SUPPORT))
def f5(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return P.supported_entities(t.g_entities, t.g_relations, evidence_of(t)).select("id", "review_state")


@query("f6_analytics_relations", oracle("SELECT id, confidence FROM sr", *GRAPH, **SUPPORT))
def f6(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return P.supported_relations(t.g_relations, evidence_of(t)).select("id", "confidence")


@query("f7_current_evidence", oracle(
    f"SELECT chunk_id, relation_id, quote FROM g_evidence WHERE relation_id IN (SELECT id FROM g_relations WHERE {NOW})",
    "g_evidence", "g_relations"))
def f7(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return P.current_evidence(evidence_of(t), t.g_entities, t.g_relations).select("chunk_id", "relation_id", "quote")


@query("f8_supported_id_batch", oracle(
    "SELECT a.entity_id AS id FROM (SELECT DISTINCT entity_id FROM g_aliases) a JOIN ce ON ce.id = a.entity_id",
    *GRAPH, "g_aliases", **CURRENT))
def f8(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    ask = t.g_aliases.select(F.col("entity_id").alias("id")).distinct()
    return ask.join(current_graph(t)[0], "id", "left_semi")


@query("f9_low_signal", f"""
SELECT doc_id, {LOW} AS low_signal FROM (
 SELECT doc_id, CASE lang WHEN 'en' THEN 'Publication_Date' WHEN 'fr' THEN source || '_year' WHEN 'de' THEN 'Sample Size' ELSE lang END AS entity_type,
        CASE WHEN n_chars < 500 THEN CAST(n_chars AS VARCHAR) || ' x 2.5%' ELSE source END AS canonical_name FROM documents) d""")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    d = Inputs(spark, sf).documents
    kind = (F.when(F.col("lang") == "en", "Publication_Date").when(F.col("lang") == "fr", F.concat("source", F.lit("_year")))
            .when(F.col("lang") == "de", "Sample Size").otherwise(F.col("lang")))
    name = F.when(F.col("n_chars") < 500, F.concat(F.col("n_chars").cast("string"), F.lit(" x 2.5%"))).otherwise(F.col("source"))
    return d.select("doc_id", P.low_signal(name, kind).alias("low_signal"))


@query("f10_source_location", oracle("SELECT id, chunk_index AS record_number, CAST(NULL AS BIGINT) AS page_number FROM g_chunks", "g_chunks"))
def f10(spark: SparkSession, sf: str) -> DataFrame:
    place = P.source_location(F.col("metadata"))
    return Inputs(spark, sf).g_chunks.select("id", place["record_number"].alias("record_number"), place["page_number"].alias("page_number"))


@query("f11_type_bucket", """
SELECT p_partkey, CASE WHEN k IN ('person','people','author','researcher') THEN 'person'
 WHEN k IN ('organization','org','organisation','company','institution') THEN 'org'
 WHEN k IN ('technology','tech','tool','framework','system') THEN 'tech'
 WHEN k IN ('concept','topic','method','technique','algorithm') THEN 'concept'
 WHEN k IN ('document','paper','article','publication','file') THEN 'document' ELSE 'unknown' END AS bucket
FROM (SELECT p_partkey, lower(trim(CASE p_type WHEN 'ECONOMY' THEN ' Company ' WHEN 'STANDARD' THEN 'Researcher'
 WHEN 'PROMO' THEN 'Tool' WHEN 'SMALL' THEN 'METHOD' WHEN 'LARGE' THEN 'paper' ELSE p_type END)) AS k FROM part) p""")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    names = {"ECONOMY": " Company ", "STANDARD": "Researcher", "PROMO": "Tool", "SMALL": "METHOD", "LARGE": "paper"}
    kind = F.col("p_type")
    for value, shown in names.items():
        kind = F.when(F.col("p_type") == value, shown).otherwise(kind)
    return Inputs(spark, sf).part.select("p_partkey", P.type_bucket(kind).alias("bucket"))


@query("f12_effective_status", """
SELECT o_orderkey, CASE WHEN s = 'indexed' AND g <> 'complete' THEN CASE WHEN g = 'failed' THEN 'failed' ELSE 'persisting' END ELSE s END AS status,
 (CASE WHEN s = 'indexed' AND g <> 'complete' THEN CASE WHEN g = 'failed' THEN 'failed' ELSE 'persisting' END ELSE s END)
   IN ('indexed','failed','cancelled','stale','delete_failed','storage_failed') AS terminal
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'P' THEN 'parsing' ELSE 'queued' END AS s,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'complete' WHEN '2-HIGH' THEN 'failed' ELSE 'extracting' END AS g FROM orders) o""")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    o = Inputs(spark, sf).orders
    s = F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "P", "parsing").otherwise("queued")
    g = (F.when(F.col("o_orderpriority") == "1-URGENT", "complete").when(F.col("o_orderpriority") == "2-HIGH", "failed")
         .otherwise("extracting"))
    status = P.effective_status(s, g)
    return o.select("o_orderkey", status.alias("status"), status.isin(*P.TERMINAL_STATUSES).alias("terminal"))


@query("f12_dataset_active", """
SELECT o_orderpriority AS dataset_id, bool_or(o_orderstatus <> 'F') AS has_active FROM orders GROUP BY 1""")
def f12_active(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "indexed").otherwise("parsing")
    return Inputs(spark, sf).orders.groupBy(F.col("o_orderpriority").alias("dataset_id")).agg(
        F.bool_or(~status.isin(*P.TERMINAL_STATUSES)).alias("has_active"))


# Joins -------------------------------------------------------------------


@query("j1_citations", oracle("""
SELECT e.relation_id, e.id AS evidence_id, e.quote, e.rank, c.chunk_index AS record_number FROM (
 SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY id) AS rank FROM g_evidence_unique) e
JOIN g_chunks c ON c.id = e.chunk_id WHERE rank <= 20""", "g_evidence_unique", "g_chunks"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return Q.citations(t.g_evidence_unique, t.g_chunks).select(
        "relation_id", F.col("id").alias("evidence_id"), "quote", "rank",
        F.col("source_location.record_number").alias("record_number"))


@query("j2_evidence_view", oracle("""
SELECT e.id, e.relation_id, c.project_id, c.dataset_id, e.quote, c.chunk_index AS record_number
FROM g_evidence_unique e JOIN g_chunks c ON c.id = e.chunk_id AND c.document_id = e.document_id""", "g_evidence_unique", "g_chunks"))
def j2(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return Q.evidence_view(t.g_evidence_unique, t.g_chunks).select(
        "id", "relation_id", "project_id", "dataset_id", "quote", F.col("source_location.record_number").alias("record_number"))


METRICS_SQL = {
    "edges": EDGES,
    "nd": "SELECT id, count(*) AS degree, sum(weight) AS wd FROM (SELECT a AS id, weight FROM edges UNION ALL SELECT b, weight FROM edges) x GROUP BY id",
    "metrics": """SELECT ce.id, coalesce(nd.degree, 0) AS degree, coalesce(nd.wd, 0.0) AS weighted_degree,
      coalesce(nd.wd, 0.0) / (2 * (SELECT sum(weight) FROM edges)) AS importance FROM ce LEFT JOIN nd ON nd.id = ce.id""",
}


@query("j3_explorer_join", oracle("""
SELECT ce.id, m.community_id, x.degree, round(x.weighted_degree, 6) AS weighted_degree
FROM ce JOIN g_members m ON m.entity_id = ce.id AND m.level = 0 JOIN metrics x ON x.id = ce.id""",
    *GRAPH, "g_members", **CURRENT, **METRICS_SQL))
def j3(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    ent, rel = current_graph(t)
    metrics = M.node_metrics(ent, M.fold_edges(rel))
    members = t.g_members.filter("level = 0").select(F.col("entity_id").alias("id"), "community_id")
    return ent.select("id").join(members, "id").join(metrics, "id").select(
        "id", "community_id", "degree", F.round("weighted_degree", 6).alias("weighted_degree"))


@query("j4_explorer_outer_join", oracle("""
SELECT ce.id, m.community_id, coalesce(x.degree, 0) AS degree, round(coalesce(x.importance, 0.0), 8) AS importance
FROM ce LEFT JOIN g_members m ON m.entity_id = ce.id AND m.level = 0 LEFT JOIN metrics x ON x.id = ce.id""",
    *GRAPH, "g_members", **CURRENT, **METRICS_SQL))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    ent, rel = current_graph(t)
    nodes = Q.explorer_nodes(ent, t.g_members, M.node_metrics(ent, M.fold_edges(rel)))
    return nodes.select("id", "community_id", "degree", F.round("importance", 8).alias("importance"))


@query("j5_alias_match", oracle("""
SELECT id FROM g_entities WHERE id IN (SELECT entity_id FROM g_aliases WHERE contains(lower(alias), 'widget'))
 OR contains(lower(canonical_name), 'widget')""", "g_entities", "g_aliases"))
def j5(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    has = lambda c: F.contains(F.lower(c), F.lit("widget"))
    hits = t.g_aliases.filter(has("alias")).select(F.col("entity_id").alias("id")).unionByName(
        t.g_entities.filter(has("canonical_name")).select("id"))
    return t.g_entities.join(hits, "id", "left_semi").select("id")


@query("j11_neighbour_pairs", oracle(f"SELECT node, other, id AS relation_id FROM ({ADJ}) a", *GRAPH, **CURRENT))
def j11(spark: SparkSession, sf: str) -> DataFrame:
    _, rel = current_graph(Inputs(spark, sf))
    return Q.adjacency(rel.select("id", "source_entity_id", "target_entity_id")).select("node", "other", F.col("id").alias("relation_id"))


@query("j12_induced_subgraph", oracle("""
SELECT id FROM cr WHERE source_entity_id IN (SELECT id FROM ce WHERE confidence = 1.0) AND target_entity_id IN (SELECT id FROM ce WHERE confidence = 1.0)""",
    *GRAPH, **CURRENT))
def j12(spark: SparkSession, sf: str) -> DataFrame:
    ent, rel = current_graph(Inputs(spark, sf))
    return Q.induced(rel.select("id", "source_entity_id", "target_entity_id"), ent.filter("confidence = 1.0")).select("id")


@query("j15_scope_check", oracle("""
SELECT r.id FROM g_relations r LEFT JOIN g_entities a ON a.id = r.source_entity_id AND a.dataset_id = r.dataset_id
LEFT JOIN g_entities b ON b.id = r.target_entity_id AND b.dataset_id = r.dataset_id WHERE a.id IS NULL OR b.id IS NULL""",
    "g_entities", "g_relations"))
def j15(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    scope = t.g_entities.select("id", "project_id", "dataset_id")
    rel = t.g_relations.select("id", "project_id", "dataset_id", "source_entity_id", "target_entity_id")
    lost = [
        rel.join(scope.withColumnRenamed("id", side), [side, "project_id", "dataset_id"], "left_anti").select("id")
        for side in ("source_entity_id", "target_entity_id")
    ]
    return lost[0].union(lost[1]).distinct()


# Aggregates --------------------------------------------------------------


@query("ag1_endpoint_degree", oracle(f"SELECT node AS id, count(*) AS degree FROM ({ADJ}) a GROUP BY node", *GRAPH, **CURRENT))
def ag1(spark: SparkSession, sf: str) -> DataFrame:
    return M.endpoint_degree(current_graph(Inputs(spark, sf))[1])


@query("ag2_supported_totals", oracle("""
SELECT project_id, dataset_id, 'entity' AS kind, count(*) AS n FROM se GROUP BY 1, 2
UNION ALL SELECT project_id, dataset_id, 'relation', count(*) FROM sr GROUP BY 1, 2""", *GRAPH, **SUPPORT))
def ag2(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    ev = evidence_of(t)
    parts = (("entity", P.supported_entities(t.g_entities, t.g_relations, ev)), ("relation", P.supported_relations(t.g_relations, ev)))
    frames = [df.groupBy("project_id", "dataset_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, df in parts]
    return frames[0].unionByName(frames[1])


@query("ag3_density", oracle("""
SELECT n AS entity_count, r AS relation_count, round(2.0 * r / (CAST(n AS DOUBLE) * (n - 1)), 10) AS density
FROM (SELECT (SELECT count(*) FROM ce) AS n, (SELECT count(*) FROM cr) AS r) x""", *GRAPH, **CURRENT))
def ag3(spark: SparkSession, sf: str) -> DataFrame:
    ent, rel = current_graph(Inputs(spark, sf))
    return Q.explorer_stats(ent, rel).withColumn("density", F.round("density", 10))


@query("ag4_edge_fold", oracle("SELECT a, b, round(weight, 6) AS weight FROM edges", *GRAPH, **CURRENT, edges=EDGES))
def ag4(spark: SparkSession, sf: str) -> DataFrame:
    return M.fold_edges(current_graph(Inputs(spark, sf))[1]).withColumn("weight", F.round("weight", 6))


@query("ag5_ag6_node_metrics", oracle(
    "SELECT id, degree, round(weighted_degree, 6) AS weighted_degree, round(importance, 10) AS importance FROM metrics",
    *GRAPH, **CURRENT, **METRICS_SQL))
def ag5(spark: SparkSession, sf: str) -> DataFrame:
    ent, rel = current_graph(Inputs(spark, sf))
    # Folding only relations between current entities is the caller's choice; here all current relations count.
    m = M.node_metrics(ent, M.fold_edges(rel))
    return m.select("id", "degree", F.round("weighted_degree", 6).alias("weighted_degree"), F.round("importance", 10).alias("importance"))


STATS_SQL = """
SELECT s.level, s.community_id, p.community_id AS parent_id, s.n AS entity_count,
 coalesce(x.internal, 0) AS internal_edges, coalesce(x.external, 0) AS external_edges,
 round(CASE WHEN s.n < 2 THEN 0.0 ELSE 2.0 * coalesce(x.internal, 0) / (CAST(s.n AS DOUBLE) * (s.n - 1)) END, 8) AS density,
 round(coalesce(x.w, 0.0) / (2 * (SELECT sum(weight) FROM edges)), 8) AS importance
FROM (SELECT level, community_id, count(*) AS n, min(entity_id) AS first FROM g_members GROUP BY 1, 2) s
LEFT JOIN g_members p ON p.entity_id = s.first AND p.level = s.level + 1
LEFT JOIN (
 SELECT level, cid, CAST(sum(CASE WHEN ca = cb THEN 1 ELSE 0 END) AS BIGINT) AS internal,
        CAST(sum(CASE WHEN ca <> cb THEN 1 ELSE 0 END) AS BIGINT) AS external, sum(weight) AS w FROM (
  SELECT ma.level, ma.community_id AS cid, ma.community_id AS ca, mb.community_id AS cb, weight
  FROM edges JOIN g_members ma ON ma.entity_id = a JOIN g_members mb ON mb.entity_id = b AND mb.level = ma.level
  UNION ALL
  SELECT ma.level, mb.community_id, ma.community_id, mb.community_id, weight
  FROM edges JOIN g_members ma ON ma.entity_id = a JOIN g_members mb ON mb.entity_id = b AND mb.level = ma.level
  WHERE ma.community_id <> mb.community_id) t GROUP BY 1, 2) x ON x.level = s.level AND x.cid = s.community_id"""


@query("ag7_community_stats", oracle(STATS_SQL, *GRAPH, "g_members", **CURRENT, edges=EDGES))
def ag7(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    stats = M.community_stats(M.fold_edges(current_graph(t)[1]), t.g_members)
    return stats.withColumn("density", F.round("density", 8)).withColumn("importance", F.round("importance", 8))


@query("ag8_quotient_graph", oracle("""
SELECT least(ma.community_id, mb.community_id) AS a, greatest(ma.community_id, mb.community_id) AS b, round(sum(weight), 4) AS weight
FROM edges JOIN g_members ma ON ma.entity_id = a AND ma.level = 0 JOIN g_members mb ON mb.entity_id = b AND mb.level = 0
WHERE ma.community_id <> mb.community_id GROUP BY 1, 2""", *GRAPH, "g_members", **CURRENT, edges=EDGES))
def ag8(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return M.quotient(M.fold_edges(current_graph(t)[1]), t.g_members.filter("level = 0")).withColumn("weight", F.round("weight", 4))


@query("ag9_community_ids", oracle(f"""
SELECT level, community_id, substr(sha256('v1:' || CAST(level AS VARCHAR) || ':' || first || ':' || digest), 1, 32) AS stable_id
FROM (SELECT level, community_id, min(entity_id) AS first, {digest('entity_id')} AS digest FROM g_members GROUP BY 1, 2) g""", "g_members"))
def ag9(spark: SparkSession, sf: str) -> DataFrame:
    return M.community_ids(Inputs(spark, sf).g_members, "v1")


@query("ag10_graph_digest", oracle(f"""
SELECT count(CASE WHEN k = 'e' THEN 1 END) AS entity_count, count(CASE WHEN k = 'r' THEN 1 END) AS relation_count, {digest('row')} AS snapshot_hash FROM (
 SELECT 'e' AS k, 'e:' || id AS row FROM ce UNION ALL
 SELECT 'r', concat_ws(':', 'r', source_entity_id, target_entity_id, CAST(CAST(round(confidence * 10000) AS BIGINT) AS VARCHAR)) FROM cr) x""",
    *GRAPH, **CURRENT))
def ag10(spark: SparkSession, sf: str) -> DataFrame:
    return M.graph_digest(*current_graph(Inputs(spark, sf)))


# Ranking, search, summary ------------------------------------------------


@query("wn4_top_evidence_per_relation", oracle("""
SELECT relation_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY confidence DESC, id) AS rank FROM g_evidence_unique) e
WHERE rank <= 3""", "g_evidence_unique"))
def wn4(spark: SparkSession, sf: str) -> DataFrame:
    ev = Inputs(spark, sf).g_evidence_unique
    return R.top_n_per_group(ev, ["relation_id"], [F.col("confidence").desc(), F.col("id")], 3, "rank").select("relation_id", "id", "rank")


@query("l1_ranked_entities", oracle(f"""
SELECT id, degree FROM (SELECT ce.*, coalesce(d.degree, 0) AS degree, {LOW} AS low FROM ce
 LEFT JOIN (SELECT node, count(*) AS degree FROM ({ADJ}) a GROUP BY node) d ON d.node = ce.id) x
WHERE NOT low ORDER BY degree DESC, lower(entity_type), lower(canonical_name), id LIMIT 200""", *GRAPH, **CURRENT))
def l1(spark: SparkSession, sf: str) -> DataFrame:
    ent, rel = current_graph(Inputs(spark, sf))
    return Q.rank_entities(ent, M.endpoint_degree(rel), 200).select("id", "degree")


@query("l3_node_page", oracle("""
SELECT id, CASE WHEN (SELECT count(*) FROM ce WHERE id > 'c10') > 100 THEN (SELECT max(id) FROM (SELECT id FROM ce WHERE id > 'c10' ORDER BY id LIMIT 100) y) END AS next_cursor
FROM (SELECT id FROM ce WHERE id > 'c10' ORDER BY id LIMIT 100) x""", *GRAPH, **CURRENT))
def l3(spark: SparkSession, sf: str) -> DataFrame:
    return R.keyset_page(current_graph(Inputs(spark, sf))[0].select("id"), "id", 100, "c10")


@query("l3_all_node_pages", oracle(
    "SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 500 + 1 AS BIGINT) AS page FROM ce", *GRAPH, **CURRENT))
def l3_all(spark: SparkSession, sf: str) -> DataFrame:
    return R.all_pages(current_graph(Inputs(spark, sf))[0].select("id"), "id", 500)


@query("l4_all_relation_pages", oracle(
    "SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 1000 + 1 AS BIGINT) AS page FROM cr", *GRAPH, **CURRENT))
def l4(spark: SparkSession, sf: str) -> DataFrame:
    return R.all_pages(current_graph(Inputs(spark, sf))[1].select("id"), "id", 1000)


@query("l6_candidate_cap", oracle("SELECT id FROM ce ORDER BY canonical_name, id LIMIT 2000", *GRAPH, **CURRENT))
def l6(spark: SparkSession, sf: str) -> DataFrame:
    return current_graph(Inputs(spark, sf))[0].orderBy("canonical_name", "id").limit(2000).select("id")


# Asked: every supplier's name, all customers by type with snapshots and history, runs of one and two letters, names of parts.
Q2_TERMS = """
SELECT concat('s', CAST(s_suppkey AS STRING)) AS query_id, concat(' SUPPLIER ', CAST(s_suppkey AS STRING)) AS q, CAST(NULL AS STRING) AS entity_type,
       CAST(NULL AS TIMESTAMP) AS as_of, CAST(NULL AS BOOLEAN) AS include_history FROM supplier
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('customer ', CAST(c_custkey AS STRING)), ' CUSTOMER',
       CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '1996-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '1998-01-01 00:00:00' END, c_custkey % 5 = 0 FROM customer
UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), substring(r_name, 2, 1), 'Nation', NULL, NULL FROM region
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), substring(n_name, 1, 2), NULL, NULL, NULL FROM nation
UNION ALL SELECT concat('m', CAST(n_nationkey AS STRING)), n_name, 'Part', NULL, NULL FROM nation
UNION ALL SELECT DISTINCT concat('p ', p_name), p_name, CAST(NULL AS STRING), CAST(NULL AS TIMESTAMP), CAST(NULL AS BOOLEAN) FROM part
UNION ALL SELECT 'blank', '  ', NULL, NULL, NULL FROM region
"""


@query("q2_entity_search", oracle("""
SELECT query_id, rank, id, canonical_name, entity_type, confidence FROM (
 SELECT t.query_id, e.*, row_number() OVER (PARTITION BY t.query_id ORDER BY (lower(canonical_name) = lower(trim(t.q))) DESC, confidence DESC, canonical_name, e.id) AS rank
 FROM q2_terms t JOIN (SELECT e.*, list(lower(n.name)) AS names FROM se e JOIN (
   SELECT id, canonical_name AS name FROM g_entities UNION ALL SELECT entity_id, alias FROM g_aliases) n ON n.id = e.id GROUP BY ALL) e
 ON trim(t.q) <> '' AND len(list_filter(e.names, lambda n: contains(n, lower(trim(t.q))))) > 0
 AND (t.entity_type IS NULL OR lower(trim(t.entity_type)) = lower(e.entity_type))
 AND (coalesce(t.include_history, false) OR CASE WHEN t.as_of IS NULL THEN e.valid_until IS NULL AND e.superseded_by IS NULL
      ELSE e.valid_from <= t.as_of AND (e.valid_until IS NULL OR e.valid_until > t.as_of) END)) x
WHERE rank <= 25""", *GRAPH, "g_aliases", **SUPPORT, q2_terms=Q2_TERMS))
def q2(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    for table in ("supplier", "customer", "region", "nation", "part"):
        t.base(table).createOrReplaceTempView(table)
    return Q.search_entities(spark.sql(Q2_TERMS), t.g_entities, t.g_aliases, t.g_relations, evidence_of(t))


NEIGHBOURS_SQL = """
SELECT root, rank, relation_id, relation_type, entity_id, canonical_name, entity_type FROM (
 SELECT a.node AS root, a.id AS relation_id, a.relation_type, a.other AS entity_id, ce.canonical_name, ce.entity_type,
        row_number() OVER (PARTITION BY a.node ORDER BY a.id) AS rank
 FROM adj a JOIN ce ON ce.id = a.other WHERE true {extra}) x WHERE rank <= 25"""


@query("q3_neighbours", oracle(NEIGHBOURS_SQL.format(extra=""), *GRAPH, **CURRENT, adj=ADJ))
def q3(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    roots = t.g_entities.select(F.col("id").alias("root"))
    return Q.neighbours(roots, t.g_entities, t.g_relations, evidence_of(t))


@query("cg7_typed_neighbours", oracle(
    NEIGHBOURS_SQL.format(extra="AND a.relation_type = 'SUPPLIES'"), *GRAPH, **CURRENT, adj=ADJ))
def cg7(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    roots = t.g_entities.select(F.col("id").alias("root"))
    return Q.neighbours(roots, t.g_entities, t.g_relations, evidence_of(t), relation_types=("SUPPLIES",))


@query("q3_neighbour_citations", oracle(f"""
SELECT n.root, n.relation_id, n.entity_id, e.id AS evidence_id, e.quote, e.rank, c.chunk_index AS record_number FROM ({NEIGHBOURS_SQL.format(extra="")}) n JOIN (
 SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY id) AS rank FROM g_evidence_unique) e ON e.relation_id = n.relation_id AND e.rank <= 20
 JOIN g_chunks c ON c.id = e.chunk_id""", *GRAPH, "g_evidence_unique", "g_chunks", **CURRENT, adj=ADJ))
def q3_citations(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    near = Q.neighbours(t.g_entities.select(F.col("id").alias("root")), t.g_entities, t.g_relations, evidence_of(t))
    rows = Q.neighbour_citations(near.select("root", "relation_id", "entity_id"), t.g_evidence_unique, t.g_chunks).select("root", "relation_id", "entity_id", F.explode("citations").alias("c"))
    return rows.select("root", "relation_id", "entity_id", "c.evidence_id", "c.quote", "c.rank", F.col("c.source_location.record_number").alias("record_number"))


TOP_100 = f"""
SELECT id FROM (SELECT ce.*, coalesce(d.degree, 0) AS degree, {LOW} AS low FROM ce
 LEFT JOIN (SELECT node, count(*) AS degree FROM ({ADJ}) a GROUP BY node) d ON d.node = ce.id) x
WHERE NOT low ORDER BY degree DESC, lower(entity_type), lower(canonical_name), id LIMIT 100"""


@query("q7_summary_relations", oracle("""
SELECT r.id, r.source_entity_id, r.target_entity_id, r.relation_type, coalesce(e.n, 0) AS n_citations, e.quotes FROM (
 SELECT * FROM cr WHERE source_entity_id IN (SELECT id FROM top) AND target_entity_id IN (SELECT id FROM top) ORDER BY id LIMIT 100) r
LEFT JOIN (SELECT relation_id, count(*) AS n, string_agg(quote, '|' ORDER BY id) AS quotes FROM (
 SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY id) AS rank FROM g_evidence_unique) v WHERE rank <= 20 GROUP BY 1) e ON e.relation_id = r.id""",
    *GRAPH, "g_evidence_unique", "g_chunks", **CURRENT, top=TOP_100))
def q7_relations(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    people, links = current_graph(t)
    rows = Q.summary_relations(Q.ranked_summary(people, links, 100), links, t.g_evidence_unique, t.g_chunks, 100, supported=True)
    quotes = F.when(F.size("citations") > 0, F.array_join(F.transform("citations", lambda c: c["quote"]), "|"))
    return rows.select("id", "source_entity_id", "target_entity_id", "relation_type", F.size("citations").cast("bigint").alias("n_citations"), quotes.alias("quotes"))


@query("q8_explorer_relations", oracle("""
SELECT id, source_entity_id, target_entity_id, relation_type, confidence FROM cr
WHERE source_entity_id IN (SELECT id FROM shown) AND target_entity_id IN (SELECT id FROM shown) ORDER BY id LIMIT 5000""",
    *GRAPH, **CURRENT, **METRICS_SQL, shown="SELECT ce.id FROM ce JOIN metrics x ON x.id = ce.id ORDER BY round(x.importance, 12) DESC, ce.id LIMIT 3000"))
def q8_relations(spark: SparkSession, sf: str) -> DataFrame:
    ent, rel = current_graph(Inputs(spark, sf))
    metrics = M.node_metrics(ent, M.fold_edges(rel))
    shown = ent.select("id").join(metrics, "id").orderBy(F.round("importance", 12).desc(), "id").limit(3000).select("id")
    return Q.relations_among(cut_lineage(shown), rel, 5000)


@query("ag10_stale_runs", oracle(f"""
SELECT dataset_id, id, created_at, snapshot_hash <> (SELECT h FROM whole) AS stale FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, id DESC) AS k FROM (
  SELECT * FROM (VALUES ('ds_a', DATE '2024-01-01', 'run1', true), ('ds_a', DATE '2024-01-02', 'run2', false), ('ds_b', DATE '2024-01-01', 'run3', false), ('ds_b', DATE '2024-01-01', 'run4', true))
   v(dataset_id, created_at, id, current) JOIN (SELECT true AS current, h AS snapshot_hash FROM whole UNION ALL SELECT false, h FROM partial_graph) USING (current)) r) x WHERE k = 1""",
    *GRAPH, **CURRENT,
    rows_of="""SELECT 'e:' || id AS row, confidence = 1.0 AS kept FROM ce
     UNION ALL SELECT concat_ws(':', 'r', source_entity_id, target_entity_id, CAST(CAST(round(confidence * 10000) AS BIGINT) AS VARCHAR)), true FROM cr""",
    whole=f"SELECT {digest('row')} AS h FROM rows_of", partial_graph=f"SELECT {digest('row')} AS h FROM rows_of WHERE kept"))
def ag10_stale(spark: SparkSession, sf: str) -> DataFrame:
    ent, rel = current_graph(Inputs(spark, sf))
    now, before = cut_lineage(M.graph_digest(ent, rel)), M.graph_digest(ent.filter("confidence = 1.0"), rel)

    def run(of: DataFrame, dataset: str, day: str, name: str) -> DataFrame:
        return of.select(F.lit("p1").alias("project_id"), F.lit(dataset).alias("dataset_id"), F.lit(day).cast("date").alias("created_at"), F.lit(name).alias("id"), "snapshot_hash")

    runs = run(now, "ds_a", "2024-01-01", "run1").unionByName(run(before, "ds_a", "2024-01-02", "run2")).unionByName(
        run(before, "ds_b", "2024-01-01", "run3")).unionByName(run(now, "ds_b", "2024-01-01", "run4"))
    return stale(latest_runs(runs), now).select("dataset_id", "id", "created_at", "stale")


@query("q7_graph_summary", oracle(f"""
SELECT id, canonical_name, entity_type, degree, (SELECT count(*) FROM ce) AS entity_count, (SELECT count(*) FROM cr) AS relation_count FROM (
 SELECT ce.*, coalesce(d.degree, 0) AS degree, {LOW} AS low FROM ce
 LEFT JOIN (SELECT node, count(*) AS degree FROM ({ADJ}) a GROUP BY node) d ON d.node = ce.id) x
WHERE NOT low ORDER BY degree DESC, lower(entity_type), lower(canonical_name), id LIMIT 100""", *GRAPH, **CURRENT))
def q7(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return Q.graph_summary(t.g_entities, t.g_relations, evidence_of(t), 100)


@query("q10_relation_evidence", oracle("""
SELECT e.relation_id, e.id, e.quote, e.rank, c.chunk_index AS record_number FROM (
 SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY id) AS rank FROM g_evidence_unique
 WHERE relation_id IN (SELECT id FROM cr)) e JOIN g_chunks c ON c.id = e.chunk_id WHERE rank <= 20""",
    *GRAPH, "g_evidence_unique", "g_chunks", **CURRENT))
def q10(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    # A relation with a citation is cited, so of the rule for support only the review is left to ask; no mark of all relations is needed.
    rel = t.g_relations.filter((F.col("review_state") != "rejected") & P.temporal_filter())
    return Q.citations(t.g_evidence_unique, t.g_chunks, rel).select(
        "relation_id", "id", "quote", "rank", F.col("source_location.record_number").alias("record_number"))


@query("q8_explorer_nodes", oracle("""
SELECT ce.id, ce.canonical_name, m.community_id, x.degree, round(x.importance, 8) AS importance
FROM ce LEFT JOIN g_members m ON m.entity_id = ce.id AND m.level = 1 JOIN metrics x ON x.id = ce.id
ORDER BY round(x.weighted_degree, 4) DESC, ce.id LIMIT 3000""", *GRAPH, "g_members", **CURRENT, **METRICS_SQL))
def q8(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    ent, rel = current_graph(t)
    nodes = Q.explorer_nodes(ent, t.g_members, M.node_metrics(ent, M.fold_edges(rel)), level=1)
    return Q.most_important(nodes, 3000).select("id", "canonical_name", "community_id", "degree", F.round("importance", 8).alias("importance"))


@query("q8_explorer_communities", oracle(
    f"""SELECT s.level, s.community_id, s.parent_id, s.entity_count, s.internal_edges, s.external_edges,
 (SELECT count(*) FROM st c WHERE c.level = s.level - 1 AND c.parent_id = s.community_id) AS child_count FROM st s""",
    *GRAPH, "g_members", **CURRENT, edges=EDGES, st=STATS_SQL))
def q8_comm(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    stats = M.community_stats(M.fold_edges(current_graph(t)[1]), t.g_members)
    return Q.children(stats).select("level", "community_id", "parent_id", "entity_count", "internal_edges", "external_edges", "child_count")


@query("j13_community_children", oracle("""
SELECT DISTINCT p.community_id AS parent_id, m.community_id AS child_id, m.level FROM g_members m JOIN g_members p
ON p.entity_id = m.entity_id AND p.level = m.level + 1""", "g_members"))
def j13(spark: SparkSession, sf: str) -> DataFrame:
    m = Inputs(spark, sf).g_members
    up = m.select("entity_id", (F.col("level") - 1).alias("level"), F.col("community_id").alias("parent_id"))
    return m.select("entity_id", "level", F.col("community_id").alias("child_id")).join(up, ["entity_id", "level"]).select("parent_id", "child_id", "level").distinct()
