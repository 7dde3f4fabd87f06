"""Registered queries that combine operators of several groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import construction as B
from evigraph.operators import measures as M
from evigraph.operators import memory as Mm
from evigraph.operators import queries as Q
from evigraph.operators import ranking as R
from evigraph.plans.graph import METRICS_SQL, current_graph
from evigraph.plans.inputs import Inputs, oracle
from evigraph.plans.registry import query
from evigraph.plans.sqlparts import CURRENT, GRAPH


@query("x3_exact_evidence", """
SELECT doc_id, CASE WHEN strpos(text, ' the ') > 0 THEN CAST(strpos(text, ' the ') - 1 AS INTEGER) END AS start_offset,
 CASE WHEN strpos(text, ' the ') > 0 THEN ' the ' END AS quote FROM documents""")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    spot = B.find_evidence(F.col("text"), F.lit(" the "), loose=False)
    return Inputs(spark, sf).documents.select("doc_id", spot["start"].alias("start_offset"), spot["quote"].alias("quote"))


@query("j14_evidence_projection", oracle("""
SELECT e.id, 'run-' || e.chunk_id AS run_id, CASE WHEN c.chunk_index = 1 THEN 'grammar' ELSE 'stored' END AS provider, c.dataset_id, r.source_entity_id, r.relation_type, r.target_entity_id
FROM g_evidence_unique e JOIN g_chunks c ON c.id = e.chunk_id JOIN g_relations r ON r.id = e.relation_id""", "g_evidence_unique", "g_chunks", "g_relations"))
def j14(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    runs = t.g_chunks.select(
        F.col("id").alias("chunk_id"), F.concat(F.lit("run-"), "id").alias("run_id"), F.when(F.col("chunk_index") == 1, "grammar").otherwise("stored").alias("provider"),
        F.lit("m").alias("model"), F.lit("v1").alias("extractor_version"))
    return B.evidence_projection(t.g_evidence_unique, runs, t.g_relations, t.g_chunks).select(
        "id", "run_id", "provider", "dataset_id", "source_entity_id", "relation_type", "target_entity_id")


@query("q9_explorer_node_page", oracle("""
SELECT n.id, n.community_id, n.degree, CASE WHEN (SELECT count(*) FROM nodes WHERE id > 'p1') > 250 THEN (SELECT max(id) FROM (SELECT id FROM nodes WHERE id > 'p1' ORDER BY id LIMIT 250) y) END AS next_cursor
FROM (SELECT * FROM nodes WHERE id > 'p1' ORDER BY id LIMIT 250) n""", *GRAPH, "g_members", **CURRENT, **METRICS_SQL,
    nodes="""SELECT ce.id, m.community_id, coalesce(x.degree, 0) AS degree FROM ce LEFT JOIN g_members m ON m.entity_id = ce.id AND m.level = 0 LEFT JOIN metrics x ON x.id = ce.id"""))
def q9(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    ent, rel = current_graph(t)
    nodes = Q.explorer_nodes(ent, t.g_members, M.node_metrics(ent, M.fold_edges(rel)))
    return R.keyset_page(nodes, "id", 250, "p1").select("id", "community_id", "degree", "next_cursor")


@query("q9_explorer_relation_page", oracle("""
SELECT id, CASE WHEN (SELECT count(*) FROM cr) > 500 THEN (SELECT max(id) FROM (SELECT id FROM cr ORDER BY id LIMIT 500) y) END AS next_cursor FROM (SELECT id FROM cr ORDER BY id LIMIT 500) n""",
    *GRAPH, **CURRENT))
def q9_relations(spark: SparkSession, sf: str) -> DataFrame:
    return R.keyset_page(current_graph(Inputs(spark, sf))[1].select("id"), "id", 500)


@query("am15_supersede_direct", oracle("""
SELECT s.episode AS item, s.replacement, CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 'different project' END AS refusal,
 CASE WHEN a.o_orderpriority = b.o_orderpriority THEN 'superseded' ELSE a.o_orderstatus END AS status
FROM m_supersession s JOIN orders a ON concat('o', CAST(a.o_orderkey AS VARCHAR)) = s.episode JOIN orders b ON concat('o', CAST(b.o_orderkey AS VARCHAR)) = s.replacement""", "m_supersession"))
def am15(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    episodes = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("project_id"), F.col("o_orderstatus").alias("status"))
    return Mm.supersede_direct(t.m_supersession.withColumnRenamed("episode", "item"), episodes)
