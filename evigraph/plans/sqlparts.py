"""SQL fragments the checks share."""

NOW = "valid_until IS NULL AND superseded_by IS NULL"

SUPPORTED_RELATIONS = """
SELECT r.* FROM g_relations r WHERE review_state <> 'rejected'
  AND (review_state = 'approved' OR EXISTS (SELECT 1 FROM g_evidence e WHERE e.relation_id = r.id))
"""
SUPPORTED_ENTITIES = """
SELECT n.* FROM g_entities n WHERE review_state <> 'rejected' AND (review_state = 'approved' OR n.id IN (
  SELECT unnest([source_entity_id, target_entity_id]) FROM g_relations r
  WHERE review_state <> 'rejected' AND EXISTS (SELECT 1 FROM g_evidence e WHERE e.relation_id = r.id)))
"""
GRAPH = ("g_entities", "g_relations", "g_evidence")
SUPPORT = {"sr": SUPPORTED_RELATIONS, "se": SUPPORTED_ENTITIES}
CURRENT = {
    **SUPPORT,
    "cr": f"SELECT * FROM sr WHERE {NOW}",
    "ce": f"SELECT * FROM se WHERE {NOW}",
}
ADJ = "SELECT *, source_entity_id AS node, target_entity_id AS other FROM cr UNION ALL SELECT *, target_entity_id, source_entity_id FROM cr"
EDGES = """
SELECT least(source_entity_id, target_entity_id) AS a, greatest(source_entity_id, target_entity_id) AS b,
       sum(confidence) AS weight FROM cr GROUP BY 1, 2
"""


def number(expr: str) -> str:
    """First 60 bits of a SHA-256 as an integer."""
    return f"CAST(('0x' || substr(sha256({expr}), 1, 15)) AS BIGINT)"


def digest(expr: str) -> str:
    return f"sha256(CAST(count({expr}) AS VARCHAR) || ':' || CAST(sum(CAST({number(expr)} AS HUGEINT)) AS VARCHAR))"


LOW = r"""(lower(trim(entity_type)) IN ('access_date','accepted_date','article_number','contract','doi','iteration_limit',
 'journal_volume','numeric value','publication_date','publication_year','received_date','revised_date','sample size','value')
 OR lower(trim(entity_type)) LIKE '%\_date' ESCAPE '\' OR lower(trim(entity_type)) LIKE '%\_year' ESCAPE '\'
 OR regexp_matches(lower(trim(canonical_name)), '^[\d\s.,%×x/–\-]+$'))"""
