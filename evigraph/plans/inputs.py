"""Graph and experience tables derived from the given Parquet tables.

Each table is one SQL text that Spark and the SQL check share (``SPARK_FORMS``
holds the exception), so a query and its check start from the same rows while
the operator under test is written twice. ``read_inputs`` registers the base tables; ``table`` derives one input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.plans.registry import with_ctes

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

G_ENTITIES = """
SELECT id, 'p1' AS project_id, 'ds_tpch' AS dataset_id, canonical_name, entity_type,
       CAST(CASE WHEN k % 5 = 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS confidence,
       CASE WHEN hub = 1 THEN 'unreviewed' WHEN k % 11 = 3 THEN 'rejected'
            WHEN k % 7 = 2 THEN 'approved' WHEN k % 5 = 0 THEN 'needs_review'
            ELSE 'unreviewed' END AS review_state,
       TIMESTAMP '1992-01-01 00:00:00' AS valid_from,
       CASE WHEN hub = 0 AND k % 13 = 5 THEN TIMESTAMP '1997-01-01 00:00:00' END AS valid_until,
       CASE WHEN hub = 0 AND k % 26 = 5 THEN concat(prefix, CAST(k + 1 AS STRING)) END AS superseded_by
FROM (
  SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, r_name AS canonical_name,
         'Region' AS entity_type, CAST(r_regionkey AS BIGINT) AS k, 1 AS hub, 'r' AS prefix FROM region
  UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), n_name, 'Nation', CAST(n_nationkey AS BIGINT), 1, 'n' FROM nation
  UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('Customer ', CAST(c_custkey AS STRING)), 'Customer', c_custkey, 0, 'c' FROM customer
  UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), concat('Supplier ', CAST(s_suppkey AS STRING)), 'Supplier', s_suppkey, 0, 's' FROM supplier
  UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), concat('Part ', CAST(p_partkey AS STRING)), 'Part', p_partkey, 0, 'p' FROM part
) e
"""

G_ALIASES = """
SELECT concat('c', CAST(c_custkey AS STRING)) AS entity_id, c_name AS alias FROM customer
UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), p_name FROM part
"""

G_RELATIONS = """
SELECT concat(rt, ':', src, ':', dst) AS id, 'p1' AS project_id, 'ds_tpch' AS dataset_id,
       src AS source_entity_id, dst AS target_entity_id, rt AS relation_type, confidence,
       CASE WHEN h % 19 = 4 THEN 'rejected' WHEN h % 23 = 1 THEN 'approved' ELSE 'unreviewed' END AS review_state,
       CAST(vf AS TIMESTAMP) AS valid_from,
       CASE WHEN h % 17 = 6 THEN CAST(vt AS TIMESTAMP) END AS valid_until,
       CAST(NULL AS STRING) AS superseded_by
FROM (
  SELECT 'PART_OF' AS rt, concat('n', CAST(n_nationkey AS STRING)) AS src, concat('r', CAST(n_regionkey AS STRING)) AS dst,
         CAST(1.0 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS h,
         TIMESTAMP '1992-01-01 00:00:00' AS vf, TIMESTAMP '1992-01-01 00:00:00' AS vt FROM nation
  UNION ALL SELECT 'LIVES_IN', concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)),
         CAST(1.0 AS DOUBLE), CAST(1 AS BIGINT), TIMESTAMP '1992-01-01 00:00:00', TIMESTAMP '1992-01-01 00:00:00' FROM customer
  UNION ALL SELECT 'BASED_IN', concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)),
         CAST(1.0 AS DOUBLE), CAST(1 AS BIGINT), TIMESTAMP '1992-01-01 00:00:00', TIMESTAMP '1992-01-01 00:00:00' FROM supplier
  UNION ALL SELECT 'SUPPLIES', concat('s', CAST(l_suppkey AS STRING)), concat('p', CAST(l_partkey AS STRING)),
         round(CAST(1.0 AS DOUBLE) - max(l_discount), 2), l_suppkey + l_partkey, min(l_shipdate), max(l_shipdate)
         FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'ORDERED', concat('c', CAST(o_custkey AS STRING)), concat('p', CAST(l_partkey AS STRING)),
         round(CAST(1.0 AS DOUBLE) - max(l_discount), 2), o_custkey + l_partkey, min(l_shipdate), max(l_shipdate)
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
) r
"""

G_EVIDENCE = """
SELECT concat('o', CAST(l_orderkey AS STRING)) AS document_id,
       concat('o', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS chunk_id,
       CASE WHEN l_linenumber % 2 = 1
            THEN concat('SUPPLIES:s', CAST(l_suppkey AS STRING), ':p', CAST(l_partkey AS STRING))
            ELSE concat('ORDERED:c', CAST(o_custkey AS STRING), ':p', CAST(l_partkey AS STRING)) END AS relation_id,
       concat('line ', CAST(l_linenumber AS STRING), ' of order ', CAST(l_orderkey AS STRING)) AS quote,
       round(CAST(1.0 AS DOUBLE) - l_discount, 2) AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

# One evidence row per (chunk, relation): line items are not unique on their key.
G_EVIDENCE_UNIQUE = """
SELECT concat(chunk_id, '|', relation_id) AS id, document_id, chunk_id,
       CAST(NULL AS STRING) AS entity_id, relation_id, quote, max(confidence) AS confidence
FROM g_evidence GROUP BY document_id, chunk_id, relation_id, quote
"""

# The same rows for Spark: grouped by the order's number, by which the join has dealt the rows out, not by texts made of it.
EVIDENCE_UNIQUE_BY_ORDER = """
SELECT concat('o', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), '|', relation_id) AS id,
       concat('o', CAST(l_orderkey AS STRING)) AS document_id,
       concat('o', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS chunk_id,
       CAST(NULL AS STRING) AS entity_id, relation_id,
       concat('line ', CAST(l_linenumber AS STRING), ' of order ', CAST(l_orderkey AS STRING)) AS quote, confidence
FROM (
  SELECT l_orderkey, l_linenumber, relation_id, max(round(CAST(1.0 AS DOUBLE) - l_discount, 2)) AS confidence
  FROM (SELECT l_orderkey, l_linenumber, l_discount,
               CASE WHEN l_linenumber % 2 = 1
                    THEN concat('SUPPLIES:s', CAST(l_suppkey AS STRING), ':p', CAST(l_partkey AS STRING))
                    ELSE concat('ORDERED:c', CAST(o_custkey AS STRING), ':p', CAST(l_partkey AS STRING)) END AS relation_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey) e
  GROUP BY l_orderkey, l_linenumber, relation_id) u
"""

# Chunks: one per (order, line number), with a record number as source location.
G_CHUNKS = """
SELECT concat('o', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS id,
       'p1' AS project_id, 'ds_tpch' AS dataset_id,
       concat('o', CAST(l_orderkey AS STRING)) AS document_id,
       CAST(l_linenumber AS BIGINT) AS chunk_index,
       concat('line ', CAST(l_linenumber AS STRING), ' of order ', CAST(l_orderkey AS STRING)) AS text,
       concat('{"record_number": ', CAST(l_linenumber AS STRING), ', "page_number": "x"}') AS metadata
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

# Merge history: consecutive customers of one nation and market segment.
G_MERGES = """
SELECT concat('c', CAST(a AS STRING)) AS source_entity_id, concat('c', CAST(b AS STRING)) AS target_entity_id FROM (
  SELECT c_custkey AS a, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS b
  FROM customer) m WHERE b IS NOT NULL
"""

# Removed documents: every order but the most urgent ones.
G_REMOVED_DOCS = """
SELECT concat('o', CAST(o_orderkey AS STRING)) AS document_id FROM orders WHERE o_orderpriority <> '1-URGENT'
"""

# Containment hierarchy used where memberships are given: customer → nation → region.
G_MEMBERS = """
SELECT id AS entity_id, level, concat('L', CAST(level AS STRING), ':', CAST(key AS STRING)) AS community_id FROM (
  SELECT concat('c', CAST(c_custkey AS STRING)) AS id, 0 AS level, CAST(c_nationkey AS BIGINT) AS key FROM customer
  UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 0, CAST(s_nationkey AS BIGINT) FROM supplier
  UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 0, CAST(p_size AS BIGINT) + 100 FROM part
  UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), 1, CAST(n_regionkey AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 1, CAST(n_regionkey AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 1, CAST(100 AS BIGINT) FROM part
  UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), 2, CAST(0 AS BIGINT) FROM customer
  UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), 2, CAST(0 AS BIGINT) FROM supplier
  UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 2, CAST(0 AS BIGINT) FROM part
) m
"""

GRAMMAR_DOCS = """
SELECT concat('gd', CAST(c_custkey AS STRING)) AS doc_id,
       concat('Customer ', CAST(c_custkey AS STRING), ' [Customer]', chr(10),
              n_name, ' [Nation]', chr(10), r_name, ' [Region]', chr(10),
              'Customer ', CAST(c_custkey AS STRING), ' -> LIVES_IN -> ', n_name, chr(10),
              n_name, ' -> PART_OF -> ', r_name) AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

SENTENCE_DOCS = """
SELECT concat('sd', CAST(c_custkey AS STRING)) AS doc_id,
       concat('Customer ', CAST(c_custkey AS STRING), ' works at ', replace(n_name, '_', ' '), '. ',
              'Firm ', CAST(c_nationkey AS STRING), ' acquired Unit ', CAST(c_custkey AS STRING), '. ',
              'Person ', CAST(c_custkey AS STRING), ' built Tool ', CAST(c_nationkey AS STRING), '; ',
              'Firm ', CAST(c_nationkey AS STRING), ' uses Spark 4.1') AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

# Experience tables -------------------------------------------------------

M_EVENTS = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value,
       concat('e', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS episode_id
FROM events
"""

M_EPISODES = """
SELECT e.episode_id AS id, 'p1' AS project_id,
       CASE WHEN user_id % 2 = 0 THEN 'engineering' ELSE 'operations' END AS domain,
       'bugfix' AS type,
       concat(first_type, ' seen by user ', CAST(user_id AS STRING)) AS title,
       concat('resolve ', last_type, ' after ', first_type) AS goal,
       concat(first_type, ' failure #', CAST(user_id % 20 AS STRING)) AS problem_signature,
       concat('repo', CAST(user_id % 5 AS STRING)) AS repository,
       CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END AS environment,
       CASE user_id % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'active' WHEN 2 THEN 'degraded'
            WHEN 3 THEN 'superseded' WHEN 4 THEN 'rejected' ELSE 'archived' END AS status,
       CAST(0.8 AS DOUBLE) AS confidence, user_id, created_at, updated_at
FROM (
  SELECT episode_id, user_id, min(ts) AS created_at, max(ts) AS updated_at,
         min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type
  FROM m_events GROUP BY episode_id, user_id
) e
"""

M_ATTEMPTS = """
SELECT concat('a', CAST(event_id AS STRING)) AS id, episode_id, CAST(event_id AS BIGINT) AS arrival, ts,
       concat('try ', event_type) AS hypothesis, event_type AS action,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'success'
            WHEN event_type = 'error' THEN 'failed' ELSE 'partial' END AS result
FROM m_events
"""

M_OUTCOMES = """
SELECT concat('out-', episode_id) AS id, episode_id,
       CASE WHEN last_type IN ('purchase', 'signup') THEN 'success'
            WHEN last_type = 'error' THEN 'failed' ELSE 'partial' END AS status,
       concat('ended with ', last_type) AS summary,
       CASE WHEN last_type IN ('purchase', 'signup') THEN concat('use ', last_type) END AS lesson
FROM (SELECT episode_id, max_by(event_type, event_id) AS last_type FROM m_events GROUP BY episode_id) o
"""

M_VERIFIERS = """
SELECT concat('v', CAST(event_id AS STRING)) AS id, concat('out-', episode_id) AS outcome_id,
       CASE event_type WHEN 'purchase' THEN 'ci' WHEN 'signup' THEN 'test' WHEN 'click' THEN 'build'
            WHEN 'view' THEN 'self_report' ELSE 'custom' END AS kind,
       concat('check ', event_type) AS name,
       CASE WHEN value > 20 THEN 'Passed' ELSE 'failed' END AS status
FROM m_events
"""

M_HOLDS = """
SELECT id AS resource_id, 'episode' AS resource_type FROM m_episodes WHERE repository = 'repo3'
"""

# Supersession: each order of a customer is replaced by the customer's next order;
# customers of one market segment add the closing pair, which forms a cycle.
M_SUPERSESSION = """
SELECT concat('o', CAST(a AS STRING)) AS episode, concat('o', CAST(b AS STRING)) AS replacement FROM (
  SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b
  FROM orders) s WHERE b IS NOT NULL
UNION ALL
SELECT concat('o', CAST(last_order AS STRING)), concat('o', CAST(first_order AS STRING)) FROM (
  SELECT o_custkey, min_by(o_orderkey, k) AS first_order, max_by(o_orderkey, k) AS last_order, count(*) AS n
  FROM (SELECT o_custkey, o_orderkey,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY') r
  GROUP BY o_custkey) c WHERE n > 1
"""

REQUEST_LOG = """
SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, event_type AS path,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency
FROM events
"""

STAGE_EVENTS = """
SELECT concat('j', CAST(user_id AS STRING)) AS job_id, event_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'reading' WHEN 'click' THEN 'chunking'
            WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS stage
FROM events
"""

DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "g_entities": (G_ENTITIES, ()),
    "g_aliases": (G_ALIASES, ()),
    "g_relations": (G_RELATIONS, ()),
    "g_evidence": (G_EVIDENCE, ()),
    "g_evidence_unique": (G_EVIDENCE_UNIQUE, ("g_evidence",)),
    "g_chunks": (G_CHUNKS, ()),
    "g_merges": (G_MERGES, ()),
    "g_removed_docs": (G_REMOVED_DOCS, ()),
    "g_members": (G_MEMBERS, ()),
    "grammar_docs": (GRAMMAR_DOCS, ()),
    "sentence_docs": (SENTENCE_DOCS, ()),
    "m_events": (M_EVENTS, ()),
    "m_episodes": (M_EPISODES, ("m_events",)),
    "m_attempts": (M_ATTEMPTS, ("m_events",)),
    "m_outcomes": (M_OUTCOMES, ("m_events",)),
    "m_verifiers": (M_VERIFIERS, ("m_events",)),
    "m_holds": (M_HOLDS, ("m_episodes",)),
    "m_supersession": (M_SUPERSESSION, ()),
    "request_log": (REQUEST_LOG, ()),
    "stage_events": (STAGE_EVENTS, ()),
}

# Tables that Spark derives by another text than the check: equal rows, fewer shuffles.
SPARK_FORMS = {"g_evidence_unique": EVIDENCE_UNIQUE_BY_ORDER}


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in DERIVED[name][1]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def oracle(body: str, *inputs: str, **ctes: str) -> str:
    """Check SQL: derived inputs, then extra CTEs, then the body."""
    parts = {name: DERIVED[name][0] for name in _closure(inputs)}
    parts.update(ctes)
    return with_ctes(body, **parts) if parts else body


class Inputs:
    """The given tables plus the derived ones, as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name not in DERIVED:
            raise AttributeError(name)
        text, needed = (SPARK_FORMS[name], ()) if name in SPARK_FORMS else DERIVED[name]
        for table in BASE_TABLES:
            if table in text:
                self.base(table).createOrReplaceTempView(table)
        for dep in needed:
            getattr(self, dep).createOrReplaceTempView(dep)
        return self.spark.sql(text)
