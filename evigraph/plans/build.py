"""Registered corpus-to-graph queries: extraction, evidence, consolidation, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import scalars as X
from evigraph.operators import construction as B
from evigraph.operators import extraction as E
from evigraph.plans.inputs import Inputs, oracle
from evigraph.plans.registry import query
from evigraph.plans.sqlparts import number
from evigraph.session import spread

SEP = "chr(31)"


def sid(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256(concat_ws({SEP}, {', '.join(parts)})), 1, 32)"


def norm(expr: str) -> str:
    return f"lower(trim(regexp_replace({expr}, '\\s+', ' ', 'g')))"


# Grammar matches per document, line by line: the check reads lines, the operator matches texts.
GRAMMAR_CTES = {
    "lines": "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM grammar_docs",
    "ents": r"""SELECT doc_id, line_no, regexp_extract(line, '^(.*?)\s*\[', 1) AS name, regexp_extract(line, '\[(.*)\]', 1) AS type FROM lines WHERE line LIKE '%[%]'""",
    "rels": """SELECT doc_id, line_no, string_split(line, ' -> ')[1] AS source, string_split(line, ' -> ')[2] AS type, string_split(line, ' -> ')[3] AS target
               FROM lines WHERE contains(line, ' -> ')""",
}


def grammar_chunks(t: Inputs) -> DataFrame:
    """Each grammar document as its only chunk."""
    return t.grammar_docs.select(
        F.col("doc_id").alias("chunk_id"), F.lit("p1").alias("project_id"), F.lit("ds_g").alias("dataset_id"),
        F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), "text")


def grammar_build(t: Inputs):
    chunks = grammar_chunks(t)
    mentions = E.grammar_entities(chunks, ["chunk_id"]).select("chunk_id", "name", "type", "confidence", "position")
    entities, entity_ev, placed = B.persist_entities(mentions, chunks, "grammar-v1", loose=False)
    rels = E.grammar_relations(chunks, ["chunk_id"])
    relations, relation_ev, resolved = B.persist_relations(rels, placed, chunks, "grammar-v1", loose=False)
    return entities, entity_ev, placed, relations, relation_ev, resolved


@query("g3_grammar_entities", oracle("SELECT doc_id, name, type FROM ents", "grammar_docs", **GRAMMAR_CTES))
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return E.grammar_entities(Inputs(spark, sf).grammar_docs, ["doc_id"]).select("doc_id", "name", "type")


@query("g3_grammar_relations", oracle("SELECT doc_id, source, type, target FROM rels", "grammar_docs", **GRAMMAR_CTES))
def g3_rel(spark: SparkSession, sf: str) -> DataFrame:
    return E.grammar_relations(Inputs(spark, sf).grammar_docs, ["doc_id"]).select("doc_id", "source", "type", "target")


@query("g4_contacts_and_skills", r"""
SELECT doc_id, 'Contact' AS type, norm AS norm_name FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}'))) AS norm FROM documents
 WHERE NOT regexp_matches(text, '[A-Z][\p{L}\p{N}_ .&''-]*?\s*\[([A-Za-z][\p{L}\p{N}_-]*)\]')) e
UNION ALL
SELECT doc_id, 'Skill', norm FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '(?i)\b(?:FastAPI|Next\.js|PostgreSQL|Docker|Python|Machine Learning|LLM|OCR|MinIO|Electron|GitHub Actions|Neo4j|Qdrant|React|TypeScript)\b'))) AS norm FROM documents
 WHERE NOT regexp_matches(text, '[A-Z][\p{L}\p{N}_ .&''-]*?\s*\[([A-Za-z][\p{L}\p{N}_-]*)\]')) s""")
def g4_contacts(spark: SparkSession, sf: str) -> DataFrame:
    found = E.heuristic_entities(spread(Inputs(spark, sf).documents.select("doc_id", "text")), ["doc_id"], phrase_stop=24)
    return found.filter("type <> 'Entity'").select("doc_id", "type", "norm_name")


@query("g4_heuristic_entities")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    # No SQL check: word boundaries over accented letters differ in the check engine; a unit test covers it.
    return E.heuristic_entities(spread(Inputs(spark, sf).documents.select("doc_id", "text")), ["doc_id"], phrase_stop=24)


@query("g5_sentence_relations", r"""
SELECT 'sd' || CAST(c_custkey AS VARCHAR) AS doc_id, v.type, v.source, v.target FROM (
 SELECT *, replace(n_name, '_', ' ') AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey) c, LATERAL (VALUES
 ('WORKS_AT', 'Customer ' || CAST(c_custkey AS VARCHAR), nation),
 ('ACQUIRED', 'Firm ' || CAST(c_nationkey AS VARCHAR), 'Unit ' || CAST(c_custkey AS VARCHAR)),
 ('BUILT', 'Person ' || CAST(c_custkey AS VARCHAR), 'Tool ' || CAST(c_nationkey AS VARCHAR)),
 ('USES', 'Firm ' || CAST(c_nationkey AS VARCHAR), 'Spark 4')) v(type, source, target)""")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return E.sentence_relations(Inputs(spark, sf).sentence_docs, ["doc_id"]).select("doc_id", "type", "source", "target")


@query("g5_sentence_entities", r"""
SELECT DISTINCT 'sd' || CAST(c_custkey AS VARCHAR) AS doc_id, v.type, v.name FROM (
 SELECT *, replace(n_name, '_', ' ') AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey) c, LATERAL (VALUES
 ('Person', 'Customer ' || CAST(c_custkey AS VARCHAR)), ('Organization', nation),
 ('Organization', 'Firm ' || CAST(c_nationkey AS VARCHAR)), ('Organization', 'Unit ' || CAST(c_custkey AS VARCHAR)),
 ('Person', 'Person ' || CAST(c_custkey AS VARCHAR)), ('Product', 'Tool ' || CAST(c_nationkey AS VARCHAR)),
 ('Technology', 'Spark 4')) v(type, name)""")
def g5_ent(spark: SparkSession, sf: str) -> DataFrame:
    rel = E.sentence_relations(Inputs(spark, sf).sentence_docs, ["doc_id"])
    return E.sentence_entities(rel, ["doc_id"]).select("doc_id", "type", "name")


ENTITY_ID = sid("ent", "'p1'", "'ds_g'", norm("name"), norm("type"))
RUN_ID = sid("run", "doc_id", "'grammar-v1'", "sha256(text)")
BUILD_CTES = {
    **GRAMMAR_CTES,
    "placed": f"SELECT e.*, d.text, {ENTITY_ID} AS entity_id, {sid('run', 'e.doc_id', chr(39) + 'grammar-v1' + chr(39), 'sha256(d.text)')} AS run_id FROM ents e JOIN grammar_docs d ON d.doc_id = e.doc_id",
    "resolved": """SELECT r.doc_id, r.type, r.source, r.target, a.entity_id AS s, b.entity_id AS t, a.run_id FROM rels r
      JOIN placed a ON a.doc_id = r.doc_id AND a.name = r.source JOIN placed b ON b.doc_id = r.doc_id AND b.name = r.target""",
}


@query("g6_entities", oracle(
    f"SELECT entity_id AS id, min_by(name, doc_id) AS canonical_name, {norm('min_by(name, doc_id)')} AS normalized_name, min_by(type, doc_id) AS entity_type, 'unreviewed' AS review_state FROM placed GROUP BY entity_id",
    "grammar_docs", **BUILD_CTES))
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return grammar_build(Inputs(spark, sf))[0].select("id", "canonical_name", "normalized_name", "entity_type", "review_state")


@query("g6_entity_evidence", oracle(
    f"SELECT {sid('ev', 'run_id', 'entity_id')} AS id, entity_id, name AS quote, CAST(strpos(text, name) - 1 AS INTEGER) AS start_offset FROM placed",
    "grammar_docs", **BUILD_CTES))
def g6_ev(spark: SparkSession, sf: str) -> DataFrame:
    return grammar_build(Inputs(spark, sf))[1].select("id", "entity_id", "quote", "start_offset")


@query("g7_relations", oracle(
    f"SELECT DISTINCT {sid('rel', chr(39) + 'ds_g' + chr(39), 's', 'type', 't', chr(39) + 'grammar-v1' + chr(39))} AS id, s AS source_entity_id, t AS target_entity_id, type AS relation_type FROM resolved",
    "grammar_docs", **BUILD_CTES))
def g7(spark: SparkSession, sf: str) -> DataFrame:
    return grammar_build(Inputs(spark, sf))[3].select("id", "source_entity_id", "target_entity_id", "relation_type")


@query("g7_relation_evidence", oracle(
    f"SELECT DISTINCT {sid('ev', 'run_id', sid('rel', chr(39) + 'ds_g' + chr(39), 's', 'type', 't', chr(39) + 'grammar-v1' + chr(39)))} AS id, doc_id AS document_id FROM resolved",
    "grammar_docs", **BUILD_CTES))
def g7_ev(spark: SparkSession, sf: str) -> DataFrame:
    return grammar_build(Inputs(spark, sf))[4].select("id", "document_id")


@query("g13_entity_documents", oracle(
    "SELECT entity_id, count(DISTINCT doc_id) AS document_count FROM placed GROUP BY entity_id", "grammar_docs", **BUILD_CTES))
def g13(spark: SparkSession, sf: str) -> DataFrame:
    return B.entity_documents(grammar_build(Inputs(spark, sf))[1])


# Endpoint resolution with ambiguous names: part names repeat, so a name resolves only when unique in its order.
PART_MENTIONS = """SELECT DISTINCT concat('o', CAST(l_orderkey AS STRING)) AS chunk_id, p_name AS name, p_brand AS type, concat('p', CAST(p_partkey AS STRING)) AS entity_id
FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query("j9_endpoint_resolution", f"""
WITH m AS ({PART_MENTIONS}), names AS (SELECT chunk_id, name, count(*) AS n, min(entity_id) AS id FROM m GROUP BY 1, 2)
SELECT r.chunk_id, r.source, r.target, CASE WHEN a.n = 1 THEN a.id END AS source_entity_id, CASE WHEN b.n = 1 THEN b.id END AS target_entity_id,
 CASE WHEN a.n = 1 AND b.n = 1 AND a.id <> b.id THEN NULL ELSE 'missing_or_ambiguous_endpoint' END AS skip_reason
FROM (SELECT chunk_id, min(name) AS source, max(name) AS target FROM m GROUP BY 1) r
LEFT JOIN names a ON a.chunk_id = r.chunk_id AND a.name = r.source LEFT JOIN names b ON b.chunk_id = r.chunk_id AND b.name = r.target""")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    line = t.lineitem.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("chunk_id"), F.col("l_partkey").alias("p_partkey"))
    m = line.join(t.part, "p_partkey").select(
        "chunk_id", F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id")).distinct()
    rel = m.groupBy("chunk_id").agg(F.min("name").alias("source"), F.max("name").alias("target"))
    placed = m.withColumn("norm_name", X.ascii_name(F.col("name"))).withColumn("norm_type", X.ascii_name(F.col("type")))
    return B.resolve_endpoints(rel, placed, loose=False).select(
        "chunk_id", "source", "target", "source_entity_id", "target_entity_id", "skip_reason")


@query("ag14_loss_report", f"""
WITH m AS ({PART_MENTIONS}), names AS (SELECT chunk_id, name, count(*) AS n, min(entity_id) AS id FROM m GROUP BY 1, 2), x AS (
SELECT r.chunk_id, CASE WHEN a.n = 1 AND b.n = 1 AND a.id <> b.id THEN 'persisted' ELSE 'missing_or_ambiguous_endpoint' END AS reason
FROM (SELECT chunk_id, min(name) AS source, max(name) AS target FROM m GROUP BY 1) r
LEFT JOIN names a ON a.chunk_id = r.chunk_id AND a.name = r.source LEFT JOIN names b ON b.chunk_id = r.chunk_id AND b.name = r.target)
SELECT chunk_id AS document_id, 'relation' AS kind, reason, count(*) AS n FROM x GROUP BY 1, 3
UNION ALL SELECT chunk_id, 'entity', 'persisted', count(*) FROM m GROUP BY 1""")
def ag14(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    line = t.lineitem.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("chunk_id"), F.col("l_partkey").alias("p_partkey"))
    m = line.join(t.part, "p_partkey").select(
        "chunk_id", F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id")).distinct()
    rel = m.groupBy("chunk_id").agg(F.min("name").alias("source"), F.max("name").alias("target"))
    placed = (m.withColumn("norm_name", X.ascii_name(F.col("name"))).withColumn("norm_type", X.ascii_name(F.col("type")))
              .withColumn("document_id", F.col("chunk_id")).withColumn("skip_reason", F.lit(None).cast("string")))
    resolved = B.resolve_endpoints(rel, placed, loose=False).withColumn("document_id", F.col("chunk_id"))
    return B.loss_report(placed, resolved).select("document_id", "kind", "reason", "n")


@query("f16_candidate_resolution", """
SELECT p_partkey, u.id AS entity_id FROM part p LEFT JOIN (SELECT lower(p_name) AS nn, lower(p_brand) AS nt, min(CAST(p_partkey AS VARCHAR)) AS id FROM part GROUP BY 1, 2 HAVING count(*) = 1) u
ON u.nn = lower(p.p_name) AND u.nt = lower(p.p_brand)""")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    part = Inputs(spark, sf).part
    ents = part.select(F.lit("d").alias("dataset_id"), F.upper("p_name").alias("canonical_name"), F.col("p_brand").alias("entity_type"), F.col("p_partkey").cast("string").alias("id"))
    mentions = part.select(F.lit("d").alias("dataset_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), "p_partkey")
    return E.resolve_candidates(mentions, ents).select("p_partkey", "entity_id")


# Stored answers ----------------------------------------------------------

ANSWERS = """SELECT c_custkey AS doc_id, concat('Customer ', CAST(c_custkey AS STRING), ' [Customer]') AS text,
 CASE c_mktsegment WHEN 'BUILDING' THEN concat('```json', chr(10), '{"nodes": [{"id": "n1", "label": "', c_name, '"}, {"id": "n2", "name": "Nation ', CAST(c_nationkey AS STRING), '", "type": "Nation", "confidence": 1.7}],',
   ' "edges": [{"from": "n1", "to": "n2", "relation": "LIVES_IN"}, {"from": "n1"}]}', chr(10), '```')
  WHEN 'MACHINERY' THEN concat('Here it is: {"entities": [{"name": "', c_name, '", "type": "Customer", "confidence": true}], "relations": []} done')
  WHEN 'HOUSEHOLD' THEN '{"entities": [], "relations": []}' ELSE 'not json' END AS content FROM customer"""


ANSWERS_PER_TASK = 5_000  # a customer file of one row group would be read, and its texts parsed, by one task


def told(spark: SparkSession, sf: str, form: str) -> DataFrame:
    """The texts that ``form`` makes of the customers, who are dealt out before they become texts."""
    rows = Inputs(spark, sf).customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    spread(rows, ANSWERS_PER_TASK).createOrReplaceTempView("customer")
    return spark.sql(form)


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return told(spark, sf, ANSWERS)


@query("x12_payload_entities", """
SELECT c_custkey AS doc_id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'Entity' ELSE 'Customer' END AS type, CAST(0.8 AS DOUBLE) AS confidence FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT c_custkey, 'Nation ' || CAST(c_nationkey AS VARCHAR), 'Nation', CAST(1.0 AS DOUBLE) FROM customer WHERE c_mktsegment = 'BUILDING'""")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    return E.payload_tables(answers(spark, sf), ["doc_id"])[0].select("doc_id", "name", "type", "confidence")


@query("x12_payload_relations", """
SELECT c_custkey AS doc_id, c_name AS source, 'LIVES_IN' AS type, 'Nation ' || CAST(c_nationkey AS VARCHAR) AS target, CAST(0.8 AS DOUBLE) AS confidence FROM customer WHERE c_mktsegment = 'BUILDING'""")
def x12_rel(spark: SparkSession, sf: str) -> DataFrame:
    return E.payload_tables(answers(spark, sf), ["doc_id"])[1].select("doc_id", "source", "type", "target", "confidence")


@query("x12_payload_aliases", """
SELECT c_custkey AS doc_id, c_name || ' / ' || CAST(c_custkey AS VARCHAR) AS aliases FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def x12_aliases(spark: SparkSession, sf: str) -> DataFrame:
    content = F.concat(F.lit('{"entities": [{"name": "n", "aliases": ["'), "c_name", F.lit('", 7, null, "'), F.col("c_custkey").cast("string"), F.lit('"]}]}'))
    docs = Inputs(spark, sf).customer.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("doc_id"), content.alias("content"))
    return E.payload_tables(docs, ["doc_id"])[0].select("doc_id", F.array_join("aliases", " / ").alias("aliases"))


# Documents without a usable answer: typed names (two spellings that fold alike), contacts and skills, or nothing at all.
SPOKEN = ANSWERS.replace("concat('Customer ', CAST(c_custkey AS STRING), ' [Customer]') AS text", """CASE c_mktsegment
  WHEN 'HOUSEHOLD' THEN concat('Mail bob', CAST(c_custkey AS STRING), '@x.org about docker') WHEN 'AUTOMOBILE' THEN concat('Straße ', CAST(c_custkey AS STRING), ' [Street] STRASSE ', CAST(c_custkey AS STRING), ' [street]; ', c_name, ' -> NEAR -> B')
  ELSE 'nothing here' END AS text""")


@query("x13_extracted_entities", """
SELECT c_custkey AS doc_id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'Entity' ELSE 'Customer' END AS type, CAST(0.8 AS DOUBLE) AS confidence, 'answer' AS extraction_source
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT c_custkey, 'Nation ' || CAST(c_nationkey AS VARCHAR), 'Nation', CAST(1.0 AS DOUBLE), 'answer' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, 'bob' || CAST(c_custkey AS VARCHAR) || '@x.org', 'Contact', CAST(0.7 AS DOUBLE), 'rules' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
UNION ALL SELECT c_custkey, 'docker', 'Skill', CAST(0.7 AS DOUBLE), 'rules' FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
UNION ALL SELECT c_custkey, 'STRASSE ' || CAST(c_custkey AS VARCHAR), 'street', CAST(1.0 AS DOUBLE), 'rules' FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    return E.extract(told(spark, sf, SPOKEN), ["doc_id"])[0].drop("aliases")


@query("x13_extracted_relations", """
SELECT c_custkey AS doc_id, c_name AS source, 'LIVES_IN' AS type, 'Nation ' || CAST(c_nationkey AS VARCHAR) AS target, 'answer' AS extraction_source FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, c_name, 'NEAR', 'B', 'rules' FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""")
def x13_relations(spark: SparkSession, sf: str) -> DataFrame:
    return E.extract(told(spark, sf, SPOKEN), ["doc_id"])[1].drop("confidence")


# Ledger, completeness, consolidation -------------------------------------

LEDGER = """SELECT concat('o', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS chunk_id, concat('o', CAST(l_orderkey AS STRING)) AS document_id,
 concat(CAST(l_shipdate AS STRING), l_returnflag, CAST(l_partkey AS STRING), '/', CAST(l_suppkey AS STRING)) AS created_at,
 CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'N' THEN 'running' ELSE 'succeeded' END AS status FROM lineitem"""


def ledger(t: Inputs) -> DataFrame:
    t.lineitem.createOrReplaceTempView("lineitem")
    return t.spark.sql(LEDGER)


LATEST = "SELECT chunk_id, max_by(status, created_at) AS status FROM led GROUP BY chunk_id"


@query("g8_ledger_latest", f"WITH led AS ({LEDGER.replace('CAST(l_shipdate AS STRING)', 'strftime(l_shipdate, ' + chr(39) + '%Y-%m-%d %H:%M:%S' + chr(39) + ')')}) {LATEST}")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    return B.ledger_latest(ledger(Inputs(spark, sf)).drop("document_id"), ["chunk_id"]).select("chunk_id", "status")


@query("j7_pending_chunks", oracle(
    "SELECT id AS chunk_id FROM g_chunks WHERE id NOT IN (SELECT chunk_id FROM latest WHERE status = 'succeeded')", "g_chunks",
    led=LEDGER.replace("CAST(l_shipdate AS STRING)", "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')"), latest=LATEST))
def j7(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return B.pending_chunks(t.g_chunks.select(F.col("id").alias("chunk_id")), ledger(t).drop("document_id"), ["chunk_id"])


@query("set5_incomplete_documents", oracle("""
SELECT c.document_id, count(*) AS missing_runs, CAST(0 AS BIGINT) AS extra_runs FROM g_chunks c
WHERE NOT EXISTS (SELECT 1 FROM led l WHERE l.chunk_id = c.id AND l.status = 'succeeded') GROUP BY 1""", "g_chunks", led=LEDGER))
def set5(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return B.incomplete_documents(t.g_chunks.select("document_id", F.col("id").alias("chunk_id")), ledger(t))


@query("g9_document_snapshots", f"""
SELECT conv_id AS document_id, count(*) AS chunk_count, sha256(CAST(count(*) AS VARCHAR) || ':' || CAST(sum(CAST({number('row')} AS HUGEINT)) AS VARCHAR)) AS snapshot_hash FROM (
 SELECT conv_id, concat_ws(':', CAST(turn AS VARCHAR), CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), sha256(text), sha256(role)) AS row FROM conversations) c GROUP BY 1""")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    conv = Inputs(spark, sf).conversations
    cid = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    chunks = conv.select(F.col("conv_id").alias("document_id"), cid.alias("chunk_id"), F.col("turn").alias("chunk_index"), "text")
    return B.document_snapshot(chunks, conv.select(cid.alias("chunk_id"), F.col("role").alias("raw_extraction")))


PROPOSED = """SELECT concat('i', CAST(event_id AS STRING)) AS item_id, 'relation' AS kind,
 concat('Customer ', CAST(c_custkey AS STRING)) AS left_name,
 CASE WHEN event_type = 'signup' THEN concat('Customer ', CAST(c_custkey AS STRING)) WHEN event_type = 'error' THEN 'Nowhere' ELSE n_name END AS right_name,
 'T' AS left_type, 'T' AS right_type,
 CASE WHEN event_type = 'view' THEN concat('missing', CAST(event_id AS STRING)) ELSE concat('gd', CAST(c_custkey AS STRING)) END AS evidence_chunk_id,
 CASE WHEN event_type = 'purchase' THEN concat('fabricated ', CAST(event_id AS STRING)) WHEN event_type = 'signup' THEN concat('Customer ', CAST(c_custkey AS STRING), ' [Customer]')
      ELSE concat('Customer ', CAST(c_custkey AS STRING), ' -> LIVES_IN -> ', n_name) END AS quote
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


@query("g10_consolidation_rules", oracle("""
SELECT item_id, CASE WHEN d.text IS NULL THEN 'unknown_chunk' WHEN NOT contains(d.text, quote) THEN 'quote_not_in_chunk'
 WHEN NOT (contains(quote, left_name) AND contains(quote, right_name)) THEN 'endpoints_not_in_quote'
 WHEN item_id <> min(item_id) OVER (PARTITION BY evidence_chunk_id, quote) THEN 'duplicate_evidence'
 WHEN left_name = right_name THEN 'self_relation' END AS reason
FROM items LEFT JOIN grammar_docs d ON d.doc_id = evidence_chunk_id""", "grammar_docs", items=PROPOSED))
def g10(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    chunks = t.grammar_docs.select(F.col("doc_id").alias("chunk_id"), "text")
    for name in ("events", "customer", "nation"):
        t.base(name).createOrReplaceTempView(name)
    return B.validate_consolidation(spark.sql(PROPOSED), chunks, loose=False).select("item_id", "reason")


@query("g11_consolidated_relations", oracle(f"""
SELECT r.doc_id AS document_id, r.type, a.entity_id AS source_entity_id, b.entity_id AS target_entity_id, CAST(NULL AS VARCHAR) AS error,
 {sid('rel', "'ds_g'", 'a.entity_id', 'r.type', 'b.entity_id', "'merge-v1'")} AS relation_id
FROM rels r JOIN ents ea ON ea.doc_id = r.doc_id AND ea.name = r.source JOIN placed a ON a.doc_id = ea.doc_id AND a.name = ea.name AND a.type = ea.type
JOIN ents eb ON eb.doc_id = r.doc_id AND eb.name = r.target JOIN placed b ON b.doc_id = eb.doc_id AND b.name = eb.name AND b.type = eb.type""",
    "grammar_docs", **BUILD_CTES))
def g11(spark: SparkSession, sf: str) -> DataFrame:
    entities, entity_ev, placed, *_ = grammar_build(Inputs(spark, sf))
    rels = E.grammar_relations(grammar_chunks(Inputs(spark, sf)), ["document_id", "dataset_id"])
    types = rels.withColumn("source_type", F.when(F.col("type") == "LIVES_IN", "Customer").otherwise("Nation")).withColumn(
        "target_type", F.when(F.col("type") == "LIVES_IN", "Nation").otherwise("Region"))
    seen = entity_ev.select("document_id", "entity_id").distinct()
    out = B.merge_consolidation(types, entities, seen, "merge-v1")
    return out.select("document_id", "type", "source_entity_id", "target_entity_id", "error", "relation_id")


@query("g11_alias_conflicts", """
SELECT lower(p_name) AS normalized_alias, p_brand AS entity_type, min(CAST(p_partkey AS VARCHAR)) AS entity_id,
 CASE WHEN count(DISTINCT p_partkey) > 1 THEN 'ambiguous_alias' END AS error FROM part GROUP BY 1, 2""")
def g11_alias(spark: SparkSession, sf: str) -> DataFrame:
    part = Inputs(spark, sf).part.select(
        F.lit("d").alias("dataset_id"), F.col("p_name").alias("alias"), F.col("p_brand").alias("entity_type"), F.col("p_partkey").cast("string").alias("entity_id"))
    return B.merge_aliases(part).select("normalized_alias", "entity_type", "entity_id", "error")
