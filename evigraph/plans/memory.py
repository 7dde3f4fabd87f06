"""Registered experience-store and governance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import scalars as X
from evigraph.functions.content import content_error
from evigraph.operators import governance as G
from evigraph.operators import memory as Mm
from evigraph.operators.ranking import sequence_in_group
from evigraph.operators.secrets import secrets_in
from evigraph.plans.inputs import Inputs, oracle
from evigraph.plans.registry import query, with_ctes
from evigraph.session import spread

HOUR = "hour"
WEIGHT = "CASE WHEN lower(status) IN ('passed','success','verified') THEN CASE kind WHEN 'ci' THEN 1.0 WHEN 'runtime' THEN 1.0 WHEN 'test' THEN 0.6 WHEN 'build' THEN 0.6 WHEN 'self_report' THEN 0.2 WHEN 'custom' THEN 0.2 ELSE 0.0 END ELSE 0.0 END"
QUALITY = f"SELECT o.*, coalesce(q.quality, 0.0) AS quality FROM m_outcomes o LEFT JOIN (SELECT outcome_id, max(CAST({WEIGHT} AS DOUBLE)) AS quality FROM m_verifiers GROUP BY 1) q ON q.outcome_id = o.id"
KEY = "coalesce(nullif(left(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 255), ''), 'unspecified')"
KEYED = f"SELECT q.*, e.project_id, {KEY.format('e.problem_signature')} AS pattern_key FROM quality q JOIN m_episodes e ON e.id = q.episode_id"
PATTERNS = """SELECT *, verified_outcomes >= 3 AND confidence >= 0.7 AS promoted FROM (SELECT *, (least(weighted_total, greatest(0.0, weighted_successes)) + 1.0) / (weighted_total + 2.0) AS confidence FROM (
 SELECT project_id, pattern_key, sum(quality) AS weighted_total, sum(quality * CASE status WHEN 'success' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END) AS weighted_successes,
 count(CASE WHEN quality > 0 THEN 1 END) AS verified_outcomes FROM keyed GROUP BY 1, 2) a) b"""
PATTERN_CTES = {"quality": QUALITY, "keyed": KEYED, "patterns": PATTERNS}
MEM = ("m_episodes", "m_outcomes", "m_verifiers")


def sequenced_attempts(t: Inputs) -> DataFrame:
    return sequence_in_group(t.m_attempts, ["episode_id"], F.hour("ts"), [F.col("ts"), F.col("arrival")])


def keyed(t: Inputs) -> DataFrame:
    return Mm.keyed_outcomes(Mm.outcome_quality(t.m_outcomes, t.m_verifiers), t.m_episodes)


SEQ = "SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ts, arrival) AS sequence FROM m_attempts"


@query("ag16_attempt_sequence", oracle("SELECT id, episode_id, sequence FROM seq", "m_attempts", seq=SEQ))
def ag16(spark: SparkSession, sf: str) -> DataFrame:
    return sequenced_attempts(Inputs(spark, sf)).select("id", "episode_id", "sequence")


@query("ag11_outcome_quality", oracle("SELECT id, round(quality, 6) AS quality FROM quality", *MEM, quality=QUALITY))
def ag11(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return Mm.outcome_quality(t.m_outcomes, t.m_verifiers).select("id", F.round("quality", 6).alias("quality"))


@query("ag12_ag13_patterns", oracle(
    "SELECT pattern_key, round(weighted_total, 6) AS weighted_total, round(weighted_successes, 6) AS weighted_successes, verified_outcomes, round(confidence, 6) AS confidence, promoted FROM patterns",
    *MEM, **PATTERN_CTES))
def ag12(spark: SparkSession, sf: str) -> DataFrame:
    p = Mm.patterns(keyed(Inputs(spark, sf)))
    return p.select("pattern_key", *[F.round(c, 6).alias(c) for c in ("weighted_total", "weighted_successes", "confidence")], "verified_outcomes", "promoted")


@query("wn2_last_success", oracle(
    "SELECT episode_id, max_by(action, sequence) AS recommended_action FROM seq WHERE result = 'success' GROUP BY 1", "m_attempts", seq=SEQ))
def wn2(spark: SparkSession, sf: str) -> DataFrame:
    return Mm.last_success(sequenced_attempts(Inputs(spark, sf)))


@query("j8_episode_outcome_pattern", oracle("""
SELECT e.id, k.pattern_key, k.lesson, round(p.confidence, 6) AS pattern_confidence FROM m_episodes e LEFT JOIN keyed k ON k.episode_id = e.id
LEFT JOIN patterns p ON p.pattern_key = k.pattern_key""", *MEM, **PATTERN_CTES))
def j8(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    out = keyed(t)
    return Mm.with_pattern(t.m_episodes, out, Mm.patterns(out)).select("id", "pattern_key", "lesson", F.round("pattern_confidence", 6).alias("pattern_confidence"))


# Content and metadata hold secrets three levels deep, numbers, booleans and a key whose text is exempt.
@query("am1_intake", """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'invalid domain' WHEN event_type = 'view' THEN 'missing summary' WHEN event_type = 'click' THEN 'invalid content' END AS reject_reason,
 CASE WHEN event_type IN ('purchase', 'signup') THEN '{"summary": "saw password=[REDACTED] in log", "verified": true, "verification_evidence": "run ' || CAST(user_id AS VARCHAR)
  || '", "extensions": {"a": {"b": [{"api_key": "[REDACTED]", "n": 1.5, "ok": false, "none": null}, "Bearer [REDACTED]"], "pattern": "password=kept"}}}' END AS content,
 CASE WHEN event_type IN ('purchase', 'signup') THEN '{"k": {"list": [[{"auth_token": "[REDACTED]"}], "plain", ' || CAST(user_id AS VARCHAR) || ']}}' END AS metadata FROM events""")
def am1(spark: SparkSession, sf: str) -> DataFrame:
    e = Inputs(spark, sf).events
    user = F.col("user_id").cast("string")
    full = F.concat(
        F.lit('{"summary": "saw password=p'), user, F.lit(' in log", "verified": true, "verification_evidence": "run '), user,
        F.lit('", "extensions": {"a": {"b": [{"api_key": {"deep": "x'), user, F.lit('"}, "n": 1.5, "ok": false, "none": null}, "Bearer t'), user,
        F.lit('"], "pattern": "password=kept"}}}'))
    content = F.when(F.col("event_type") == "view", '{"fix": "none"}').when(F.col("event_type") == "click", F.concat(full, F.lit("x"))).otherwise(full)
    metadata = F.concat(F.lit('{"k": {"list": [[{"auth_token": ["a", "b"]}], "plain", '), user, F.lit("]}}"))
    raw = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "cooking").otherwise("engineering").alias("domain"),
        F.lit("bugfix").alias("type"), metadata.alias("metadata"), content.alias("content"))
    good, bad = Mm.intake(raw)
    nothing = F.lit(None).cast("string")
    return good.select("id", nothing.alias("reject_reason"), "content", "metadata").unionByName(
        bad.select("id", "reject_reason", nothing.alias("content"), nothing.alias("metadata")))


@query("am2_episode_attempts", oracle(
    "SELECT episode_id, string_agg(result, ',' ORDER BY sequence) AS results FROM seq GROUP BY 1", "m_attempts", seq=SEQ))
def am2(spark: SparkSession, sf: str) -> DataFrame:
    pages = Mm.episode_attempt_pages(sequenced_attempts(Inputs(spark, sf)))
    # Test data needs one page per episode; pages stay separate rows in general.
    return pages.select("episode_id", F.array_join(F.transform("attempts", lambda a: a["result"]), ",").alias("results"))


@query("am3_attempt_status", oracle("""
SELECT e.id, CASE WHEN e.status IN ('open', 'active', 'degraded') THEN CASE WHEN l.last = 'failed' THEN 'degraded' ELSE 'active' END ELSE e.status END AS status
FROM m_episodes e JOIN (SELECT episode_id, max_by(result, arrival) AS last FROM m_attempts GROUP BY 1) l ON l.episode_id = e.id""", "m_episodes", "m_attempts"))
def am3(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return Mm.attempt_status(t.m_episodes, t.m_attempts, "arrival").select("id", "status")


@query("am4_outcome_admission", oracle("""
SELECT a.id, CASE WHEN e.status IN ('superseded', 'rejected') THEN 'episode is closed' WHEN a.k > 1 THEN 'episode already has an outcome' END AS refusal
FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY arrival) AS k FROM m_attempts) a JOIN m_episodes e ON e.id = a.episode_id""", "m_episodes", "m_attempts"))
def am4(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    ok, refused = Mm.accept_outcomes(t.m_attempts, t.m_episodes, ["arrival"])
    return ok.select("id", F.lit(None).cast("string").alias("refusal")).unionByName(refused.select("id", "refusal"))


WORDS = "list_filter(regexp_split_to_array(lower(concat_ws(' ', e.title, e.goal, e.problem_signature)), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
# Asked: three fixed searches, then one per user whose words are no words of any episode but substrings of some.
ASKED_SQL = """
SELECT 'q1' AS query_id, 'signup' AS q, CAST(NULL AS STRING) AS environment
UNION ALL SELECT 'q2', 'Purchase', 'prod' UNION ALL SELECT 'q3', 'purch zzz', NULL
UNION ALL SELECT DISTINCT concat('u', CAST(user_id AS STRING)), concat('zq x ', CAST(user_id AS STRING), CASE WHEN user_id < 3 THEN '\u00a0Ser' ELSE '' END, ' ZZ a2 a3 user'), CAST(NULL AS STRING) FROM events
"""
SEARCH_SQL = f"""
SELECT query_id, id, rank, round(score, 6) AS score, pattern_key FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, created_at DESC, id) AS rank FROM (
  SELECT t.query_id, e.id, e.created_at, k.pattern_key, 0.1 * len(list_filter({WORDS}, lambda x: x = lower(t.q))) + CASE WHEN t.environment IS NULL THEN 0.0 ELSE 0.25 END
   + CASE WHEN e.problem_signature = t.q THEN 2.0 ELSE 0.0 END + CASE WHEN p.promoted THEN 0.5 ELSE 0.0 END + coalesce(p.confidence, 0.0) AS score
  FROM (SELECT * FROM asked WHERE query_id IN ('q1', 'q2')) t JOIN m_episodes e ON list_contains({WORDS}, lower(t.q)) AND (t.environment IS NULL OR e.environment = t.environment)
  LEFT JOIN keyed k ON k.episode_id = e.id LEFT JOIN patterns p ON p.pattern_key = k.pattern_key
  WHERE e.status NOT IN ('superseded', 'rejected')
  UNION ALL
  SELECT DISTINCT t.query_id, e.id, e.created_at, k.pattern_key, 0.0
  FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(q), '[ \u00a0]+'), lambda w: length(w) > 1)[1:5]) AS w FROM asked WHERE query_id NOT IN ('q1', 'q2')) t
  JOIN m_episodes e ON contains(lower(e.title), t.w) OR contains(lower(e.goal), t.w) OR contains(lower(e.problem_signature), t.w) LEFT JOIN keyed k ON k.episode_id = e.id
  WHERE e.status NOT IN ('superseded', 'rejected')) x) y WHERE rank <= 25"""
# The audit looks for all words of a query.
AUDIT_SEARCH_SQL = SEARCH_SQL.replace("[1:5]", "")


def searched(spark: SparkSession, sf: str, fallback_words: int | None = 5) -> DataFrame:
    t = Inputs(spark, sf)
    out = keyed(t)
    t.events.createOrReplaceTempView("events")
    return Mm.search(spark.sql(ASKED_SQL), t.m_episodes, out, Mm.patterns(out), sequenced_attempts(t), fallback_words=fallback_words)


@query("am5_am6_search", oracle(SEARCH_SQL, *MEM, **PATTERN_CTES, asked=ASKED_SQL))
def am5(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf).select("query_id", "id", "rank", F.round("score", 6).alias("score"), "pattern_key")


@query("am7_search_assembly", oracle(f"""
SELECT r.query_id, r.id, o.lesson, s.recommended_action FROM ({SEARCH_SQL}) r JOIN m_outcomes o ON o.episode_id = r.id
LEFT JOIN (SELECT episode_id, max_by(action, sequence) AS recommended_action FROM seq WHERE result = 'success' GROUP BY 1) s ON s.episode_id = r.id""",
    *MEM, "m_attempts", **PATTERN_CTES, seq=SEQ, asked=ASKED_SQL))
def am7(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf).select("query_id", "id", "lesson", "recommended_action")


@query("am8_retrieval_audit", oracle(f"""
SELECT query_id, string_agg(id, ',' ORDER BY rank) AS episode_ids, '[redacted]' AS query FROM ({AUDIT_SEARCH_SQL}) r GROUP BY 1""", *MEM, **PATTERN_CTES, asked=ASKED_SQL))
def am8(spark: SparkSession, sf: str) -> DataFrame:
    audit = Mm.retrieval_audit(searched(spark, sf, fallback_words=None))
    return audit.select("query_id", F.array_join(F.transform("results", lambda r: r["episode_id"]), ",").alias("episode_ids"), "query")


SCORE = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"
FEED = f"SELECT concat('pattern-', CAST(user_id AS STRING)) AS pattern_key, episode_id, event_id, ts, event_type, CAST({SCORE} AS BIGINT) AS score FROM m_events"


def feed(t: Inputs) -> DataFrame:
    t.m_events.createOrReplaceTempView("m_events")
    return t.spark.sql(FEED)


@query("am9_feedback_scores", oracle("SELECT episode_id, CAST(sum(score) AS BIGINT) AS feedback_score FROM feed GROUP BY 1", "m_events", feed=FEED))
def am9(spark: SparkSession, sf: str) -> DataFrame:
    return Mm.feedback_scores(feed(Inputs(spark, sf)))


def _recursive(body: str, *inputs: str, **ctes: str) -> str:
    return oracle(body, *inputs, **ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("am10_pattern_feedback", _recursive("""
SELECT pattern_key, round(x / 10.0, 6) AS weighted_successes, round((least(5.0, x / 10.0) + 1.0) / 7.0, 6) AS confidence FROM (
 SELECT pattern_key, x, row_number() OVER (PARTITION BY pattern_key ORDER BY k DESC) AS last FROM fold) f WHERE last = 1""", "m_events", feed=FEED,
    num="SELECT *, row_number() OVER (PARTITION BY pattern_key ORDER BY ts, event_id) AS k FROM feed",
    fold="""SELECT DISTINCT pattern_key, CAST(0 AS BIGINT) AS k, CAST(2 AS BIGINT) AS x FROM num
      UNION ALL SELECT f.pattern_key, n.k, greatest(0, f.x + n.score) FROM fold f JOIN num n ON n.pattern_key = f.pattern_key AND n.k = f.k + 1"""))
def am10(spark: SparkSession, sf: str) -> DataFrame:
    events = feed(Inputs(spark, sf))
    base = events.select("pattern_key").distinct().withColumns(
        {"weighted_successes": F.lit(0.2), "weighted_total": F.lit(5.0), "verified_outcomes": F.lit(3)})
    out = Mm.pattern_feedback(base, events, F.date_trunc("day", "ts"), [F.col("ts"), F.col("event_id")])
    return out.select("pattern_key", F.round("weighted_successes", 6).alias("weighted_successes"), F.round("confidence", 6).alias("confidence"))


CYCLES = {
    "walk": """SELECT item, replacement AS cur, CAST(1 AS BIGINT) AS hops FROM links
      UNION ALL SELECT w.item, l.replacement, w.hops + 1 FROM walk w JOIN links l ON l.item = w.cur WHERE w.cur <> w.item AND w.hops < 500""",
    "ends": "SELECT item, cur, hops, row_number() OVER (PARTITION BY item ORDER BY hops DESC) AS last FROM walk",
}
LINKS = "SELECT episode AS item, replacement FROM m_supersession"


@query("am11_supersession_chains", _recursive(
    "SELECT item, CASE WHEN cur <> item THEN cur END AS final, cur = item AS cycle, CASE WHEN cur <> item THEN hops END AS hops FROM ends WHERE last = 1",
    "m_supersession", links=LINKS, **CYCLES))
def am11(spark: SparkSession, sf: str) -> DataFrame:
    links = Inputs(spark, sf).m_supersession.select(F.col("episode").alias("item"), "replacement")
    return Mm.supersession_roots(links).select("item", "final", "cycle", "hops")


@query("am11_supersede_requests", _recursive("""
SELECT r.item, r.replacement, CASE WHEN a.o_orderstatus = 'O' OR b.o_orderstatus = 'O' THEN 'already superseded' WHEN e.cur = e.item THEN 'cycle' WHEN e.cur = r.item THEN 'cycle' END AS refusal
FROM (SELECT replacement AS item, item AS replacement FROM links) r JOIN orders a ON concat('o', CAST(a.o_orderkey AS VARCHAR)) = r.item JOIN orders b ON concat('o', CAST(b.o_orderkey AS VARCHAR)) = r.replacement
LEFT JOIN ends e ON e.item = r.replacement AND e.last = 1""", "m_supersession", links=LINKS, **CYCLES))
def am11_requests(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    links = t.m_supersession.select(F.col("episode").alias("item"), "replacement")
    items = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"),
                            F.when(F.col("o_orderstatus") == "O", "superseded").otherwise("active").alias("status"))
    back = links.select(F.col("replacement").alias("item"), F.col("item").alias("replacement"))
    return Mm.supersede(back, items, links)


@query("am12_dangling_links", oracle("""
SELECT episode, replacement FROM m_supersession WHERE replacement NOT IN (SELECT concat('o', CAST(o_orderkey AS STRING)) FROM orders WHERE o_orderstatus <> 'P')""", "m_supersession"))
def am12(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    items = t.orders.filter("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return Mm.dangling_links(t.m_supersession, items).select("episode", "replacement")


KIND = "CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'stale' WHEN 'signup' THEN 'verified' ELSE 'correct' END"
TYPED = f"SELECT concat('u', CAST(user_id AS STRING)) AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, {KIND} AS kind, CASE WHEN value > 20 THEN 0.5 END AS confidence FROM events"


def typed_feedback(t: Inputs) -> DataFrame:
    e = t.events.withColumn("kind", F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "reject")
                            .when(F.col("event_type") == "click", "stale").when(F.col("event_type") == "signup", "verified").otherwise("correct"))
    seq = sequence_in_group(e, ["user_id"], F.date_trunc("day", "ts"), [F.col("ts"), F.col("event_id")])
    return seq.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("episode_id"), "sequence", "kind",
                      F.when(F.col("value") > 20, 0.5).alias("confidence"))


@query("am13_confidence_feedback", _recursive("""
SELECT f.episode_id AS id, round(f.c, 6) AS confidence, coalesce(s.status, 'open') AS status, g.score AS feedback_score, g.version FROM (
 SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY k DESC) AS last FROM fold) f
JOIN (SELECT episode_id, CAST(sum(CASE kind WHEN 'confirm' THEN 1 WHEN 'reject' THEN -1 WHEN 'verified' THEN 2 ELSE 0 END) AS BIGINT) AS score,
 CAST(1 + sum(CASE WHEN kind = 'correct' THEN 1 ELSE 0 END) AS BIGINT) AS version FROM typed GROUP BY 1) g ON g.episode_id = f.episode_id
LEFT JOIN (SELECT episode_id, max_by(CASE kind WHEN 'reject' THEN 'rejected' ELSE 'degraded' END, sequence) AS status FROM typed WHERE kind IN ('reject', 'stale') GROUP BY 1) s ON s.episode_id = f.episode_id
WHERE f.last = 1""", typed=TYPED,
    fold="""SELECT DISTINCT episode_id, CAST(0 AS BIGINT) AS k, CAST(0.8 AS DOUBLE) AS c FROM typed
      UNION ALL SELECT f.episode_id, t.sequence, CAST(CASE t.kind WHEN 'confirm' THEN least(1.0, f.c + 0.1) WHEN 'reject' THEN 0.0 WHEN 'stale' THEN greatest(0.0, f.c - 0.2) WHEN 'verified' THEN 1.0 ELSE coalesce(t.confidence, f.c) END AS DOUBLE)
      FROM fold f JOIN typed t ON t.episode_id = f.episode_id AND t.sequence = f.k + 1"""))
def am13(spark: SparkSession, sf: str) -> DataFrame:
    fb = typed_feedback(Inputs(spark, sf))
    base = fb.select(F.col("episode_id").alias("id")).distinct().withColumns({"confidence": F.lit(0.8), "status": F.lit("open")})
    return Mm.confidence_feedback(base, fb).select("id", F.round("confidence", 6).alias("confidence"), "status", "feedback_score", "version")


@query("am16_wn8_version_history", with_ctes("""
SELECT 'ver_' || episode_id || '_v' || CAST(version AS VARCHAR) AS id, episode_id, version, sequence FROM (
 SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY sequence) AS version FROM typed WHERE kind = 'correct') v""", typed=TYPED))
def am16(spark: SparkSession, sf: str) -> DataFrame:
    return Mm.version_history(typed_feedback(Inputs(spark, sf))).select("id", "episode_id", "version", "sequence")


@query("am14_merge_episodes", """
SELECT o_orderkey AS source_id, nxt AS target_id, CASE WHEN t_seg <> o_orderpriority THEN 'different type' END AS refusal, greatest(o_totalprice, t_price) AS confidence, CAST(2 AS INTEGER) AS version FROM (
 SELECT *, lead(o_orderkey) OVER w AS nxt, lead(o_orderpriority) OVER w AS t_seg, lead(o_totalprice) OVER w AS t_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) x WHERE nxt IS NOT NULL""")
def am14(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    t.orders.createOrReplaceTempView("orders")
    pairs = spark.sql("""SELECT o_orderkey AS source_id, nxt AS target_id FROM (
      SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) x WHERE nxt IS NOT NULL""")
    ep = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("p1").alias("project_id"), F.col("o_orderpriority").alias("type"),
                         F.lit("{}").alias("content"), F.col("o_totalprice").alias("confidence"), F.lit(1).alias("version"))
    return Mm.merge_episodes(pairs, ep).select("source_id", "target_id", "refusal", "confidence", "version")


GRAPH_MEM = (*MEM, "m_attempts")


def memory_view(t: Inputs) -> tuple[DataFrame, DataFrame]:
    out = keyed(t)
    evidence = t.m_attempts.select(F.concat(F.lit("ref-"), "id").alias("id"), "episode_id", F.concat(F.lit("log/"), "id").alias("reference"))
    return Mm.memory_graph(t.m_episodes, sequenced_attempts(t), out, Mm.patterns(out), t.m_verifiers, evidence)


@query("am17_memory_graph_nodes", oracle("""
SELECT id, 'episode' AS type, title AS label FROM m_episodes
UNION ALL SELECT id, 'attempt', '#' || CAST(sequence AS VARCHAR) || ': ' || left(hypothesis, 60) FROM seq
UNION ALL SELECT id, 'outcome', status || ': ' || left(summary, 60) FROM m_outcomes
UNION ALL SELECT 'pat-' || pattern_key, 'pattern', pattern_key FROM patterns
UNION ALL SELECT id, 'verifier', kind || ': ' || name FROM m_verifiers
UNION ALL SELECT 'ref-' || id, 'evidence', left('log/' || id, 80) FROM m_attempts""", *GRAPH_MEM, **PATTERN_CTES, seq=SEQ))
def am17_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return memory_view(Inputs(spark, sf))[0].select("id", "type", "label")


@query("am17_memory_graph_edges", oracle("""
SELECT 'eat-' || episode_id || '-' || id AS id, episode_id AS source, id AS target, 'has_attempt' AS type FROM m_attempts
UNION ALL SELECT 'eou-' || episode_id || '-' || id, episode_id, id, 'has_outcome' FROM m_outcomes
UNION ALL SELECT 'omp-' || id || '-pat-' || pattern_key, id, 'pat-' || pattern_key, 'matches_pattern' FROM keyed
UNION ALL SELECT 'ovr-' || outcome_id || '-' || id, outcome_id, id, 'verified_by' FROM m_verifiers
UNION ALL SELECT 'eev-' || episode_id || '-ref-' || id, episode_id, 'ref-' || id, 'has_evidence' FROM m_attempts""", *GRAPH_MEM, **PATTERN_CTES))
def am17_edges(spark: SparkSession, sf: str) -> DataFrame:
    return memory_view(Inputs(spark, sf))[1].select("id", "source", "target", "type")


@query("am17_memory_graph_counts", oracle("""
SELECT 'episode' AS type, count(*) AS n FROM m_episodes UNION ALL SELECT 'attempt', count(*) FROM m_attempts UNION ALL SELECT 'outcome', count(*) FROM m_outcomes
UNION ALL SELECT 'pattern', count(*) FROM patterns UNION ALL SELECT 'verifier', count(*) FROM m_verifiers UNION ALL SELECT 'evidence', count(*) FROM m_attempts""", *GRAPH_MEM, **PATTERN_CTES))
def am17_counts(spark: SparkSession, sf: str) -> DataFrame:
    return memory_view(Inputs(spark, sf))[0].groupBy("type").agg(F.count("*").alias("n"))


@query("l7_recent_episodes", oracle("SELECT id, status FROM m_episodes WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 25", "m_episodes"))
def l7(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).m_episodes.filter("status = 'active'").orderBy(F.col("created_at").desc(), "id").limit(25).select("id", "status")


@query("am25_filters", oracle("SELECT id FROM m_episodes WHERE status IN ('open', 'active') AND domain IN ('engineering') AND type IN ('bugfix')", "m_episodes"))
def am25(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).m_episodes.filter(
        F.col("status").isin("open", "active") & F.col("domain").isin("engineering") & F.col("type").isin("bugfix")).select("id")


# Governance --------------------------------------------------------------

CUT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("am19_retention_preview", oracle(f"""
SELECT id, status FROM m_episodes WHERE created_at < {CUT} AND status IN ('active', 'open') AND id NOT IN (SELECT resource_id FROM m_holds)""", "m_episodes", "m_holds"))
def am19(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return G.retention_candidates(t.m_episodes, F.lit("2024-01-15").cast("timestamp"), "archive", t.m_holds).select("id", "status")


@query("am19_retention_archive", oracle(f"""
SELECT id, CASE WHEN created_at < {CUT} AND status IN ('active', 'open') AND id NOT IN (SELECT resource_id FROM m_holds) THEN 'archived' ELSE status END AS status FROM m_episodes""", "m_episodes", "m_holds"))
def am19_archive(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return G.apply_retention(t.m_episodes, F.lit("2024-01-15").cast("timestamp"), "archive", t.m_holds).select("id", "status")


@query("j6_retention_delete", oracle(f"""
SELECT id FROM m_episodes WHERE NOT (created_at < {CUT} AND status IN ('archived', 'superseded', 'rejected') AND id NOT IN (SELECT resource_id FROM m_holds))""", "m_episodes", "m_holds"))
def j6(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return G.apply_retention(t.m_episodes, F.lit("2024-01-15").cast("timestamp"), "delete", t.m_holds).select("id")


@query("am18_delete_modes", oracle("""
SELECT id, CASE WHEN environment = 'prod' THEN 'archived' WHEN status = 'open' THEN 'rejected' ELSE status END AS status FROM m_episodes
WHERE environment = 'prod' OR status = 'open' OR id IN (SELECT resource_id FROM m_holds)""", "m_episodes", "m_holds"))
def am18(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    mode = F.when(F.col("environment") == "prod", "archive").when(F.col("status") == "open", "invalidate").otherwise("hard")
    return G.delete_episodes(t.m_episodes, t.m_episodes.select("id", mode.alias("mode")), t.m_holds)[0].select("id", "status")


@query("am21_place_holds", oracle("""
SELECT a.id AS hold_id, CASE WHEN a.result = 'failed' THEN 'unknown episode' WHEN h.resource_id IS NOT NULL OR a.id <> min(a.id) OVER (PARTITION BY a.episode_id, a.result = 'failed') THEN 'duplicate' ELSE 'placed' END AS result
FROM m_attempts a LEFT JOIN m_holds h ON h.resource_id = a.episode_id""", "m_attempts", "m_holds"))
def am21(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    target = F.when(F.col("result") == "failed", F.concat(F.lit("?"), "episode_id")).otherwise(F.col("episode_id"))
    asked = t.m_attempts.select(F.col("id").alias("hold_id"), target.alias("resource_id"), F.lit("episode").alias("resource_type"))
    return G.place_holds(asked, t.m_holds, t.m_episodes).select("hold_id", "result")


@query("am22_audit_counts", oracle("""
SELECT 'episode.create' AS operation, 'episode' AS resource_type, count(*) AS n FROM m_episodes UNION ALL SELECT 'attempt.append', 'attempt', count(*) FROM m_attempts
UNION ALL SELECT 'outcome.record', 'outcome', count(*) FROM m_outcomes""", "m_episodes", "m_attempts", "m_outcomes"))
def am22(spark: SparkSession, sf: str) -> DataFrame:
    return audit(Inputs(spark, sf)).groupBy("operation", "resource_type").agg(F.count("*").alias("n"))


def audit(t: Inputs) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return G.audit_trail({
        "episode.create": (t.m_episodes, "episode", F.col("id"), F.col("created_at")),
        "attempt.append": (t.m_attempts, "attempt", F.col("id"), F.col("ts")),
        "outcome.record": (t.m_outcomes, "outcome", F.col("id"), none)})


@query("am22_latest_audit", oracle("SELECT id AS resource_id FROM m_attempts ORDER BY ts DESC, id LIMIT 50", "m_attempts"))
def am22_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit(Inputs(spark, sf)).filter("resource_type = 'attempt' AND operation = 'attempt.append'")
    return rows.orderBy(F.col("created_at").desc(), "resource_id").limit(50).select("resource_id")


@query("am23_idempotent_create", with_ctes("""
SELECT n.user_id, n.event_type, n.event_id, c.anchor AS answered_by FROM chain c JOIN num n ON n.user_id = c.user_id AND n.event_type = c.event_type AND n.k = c.k""",
    num="SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events",
    chain="""SELECT user_id, event_type, k, event_id AS anchor, ts AS at FROM num WHERE k = 1
     UNION ALL SELECT n.user_id, n.event_type, n.k, CASE WHEN n.ts - c.at > INTERVAL 24 HOUR THEN n.event_id ELSE c.anchor END, CASE WHEN n.ts - c.at > INTERVAL 24 HOUR THEN n.ts ELSE c.at END
     FROM chain c JOIN num n ON n.user_id = c.user_id AND n.event_type = c.event_type AND n.k = c.k + 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def am23(spark: SparkSession, sf: str) -> DataFrame:
    return G.idempotent_first(Inputs(spark, sf).events, ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "answered_by")


# A third of all events share one key.
HOT_KEYS = "SELECT CASE WHEN event_id % 3 = 0 THEN 'shared' ELSE concat('user ', CAST(user_id AS STRING)) END AS account, event_id, ts FROM events"


@query("am23_hot_key", with_ctes("""
SELECT k.account, k.event_id, arg_max(c.event_id, c.ts) AS answered_by FROM keyed k JOIN chain c
ON c.account = k.account AND (c.ts < k.ts OR c.ts = k.ts AND c.event_id <= k.event_id) GROUP BY 1, 2""",
    keyed=HOT_KEYS,
    moments="SELECT account, ts, min(event_id) AS event_id FROM keyed GROUP BY 1, 2",
    nxt="""SELECT m.account, m.ts, n.ts AS nts, n.event_id AS nid FROM (
      SELECT account, ts, min(ts) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN INTERVAL 86400000001 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nts FROM moments) m
      JOIN moments n ON n.account = m.account AND n.ts = m.nts""",
    chain="""SELECT account, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM moments GROUP BY 1
     UNION ALL SELECT c.account, n.nts, n.nid FROM chain c JOIN nxt n ON n.account = c.account AND n.ts = c.ts""").replace("WITH ", "WITH RECURSIVE ", 1))
def am23_hot(spark: SparkSession, sf: str) -> DataFrame:
    Inputs(spark, sf).events.createOrReplaceTempView("events")
    return G.idempotent_first(spark.sql(HOT_KEYS), ["account"])


# Every fourth request has no key; errors commit content without a summary.
RECORDED = """
SELECT event_id AS request_id, 'p1' AS project_id, CASE WHEN event_type IN ('view', 'click') THEN 'observe' ELSE 'commit' END AS operation,
       CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'bugfix' END AS kind,
       CASE WHEN event_type = 'error' THEN '{"fix": "x"}' ELSE '{"summary": "s", "extensions": {"deep": [{"password": "hunter2"}]}}' END AS content,
       props AS metadata, CASE WHEN event_type = 'signup' THEN 0.9 END AS confidence,
       CASE WHEN event_id % 4 <> 0 THEN CONCAT('key ', CAST(user_id AS STRING)) END AS idempotency_key, ts FROM events
"""


@query("am24_recorded_episodes", with_ctes("""
SELECT r.request_id, CASE WHEN r.request_id % 4 <> 0 AND r.kind || r.content <> 'bugfix{"fix": "x"}' THEN (
   SELECT arg_max(c.request_id, c.ts) FROM chain c WHERE c.idempotency_key = r.idempotency_key AND (c.ts < r.ts OR c.ts = r.ts AND c.request_id <= r.request_id))
  WHEN r.content <> '{"fix": "x"}' THEN r.request_id END AS answered_by,
 CASE WHEN r.content = '{"fix": "x"}' THEN 'missing summary' END AS refusal FROM recorded r""",
    recorded=RECORDED,
    moments="SELECT idempotency_key, ts, min(request_id) AS request_id FROM recorded WHERE content <> '{\"fix\": \"x\"}' AND idempotency_key IS NOT NULL GROUP BY 1, 2",
    nxt="""SELECT m.idempotency_key, m.ts, n.ts AS nts, n.request_id AS nid FROM (
      SELECT idempotency_key, ts, min(ts) OVER (PARTITION BY idempotency_key ORDER BY ts RANGE BETWEEN INTERVAL 86400000001 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nts FROM moments) m
      JOIN moments n ON n.idempotency_key = m.idempotency_key AND n.ts = m.nts""",
    chain="""SELECT idempotency_key, min(ts) AS ts, arg_min(request_id, ts) AS request_id FROM moments GROUP BY 1
     UNION ALL SELECT c.idempotency_key, n.nts, n.nid FROM chain c JOIN nxt n ON n.idempotency_key = c.idempotency_key AND n.ts = c.ts""").replace("WITH ", "WITH RECURSIVE ", 1))
def am24(spark: SparkSession, sf: str) -> DataFrame:
    Inputs(spark, sf).events.createOrReplaceTempView("events")
    return Mm.recorded(spark.sql(RECORDED))[1].select("request_id", "answered_by", "refusal")


@query("am24_stored_content", """
SELECT kind AS title, CAST(confidence AS DOUBLE) AS confidence, '{"summary": "s", "extensions": {"deep": [{"password": "[REDACTED]"}]}}' AS content, count(*) AS n FROM (
 SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'commit: bugfix' END AS kind, CASE WHEN event_type = 'signup' THEN 0.9 ELSE 0.5 END AS confidence
 FROM events WHERE event_id % 4 = 0 AND event_type <> 'error') e GROUP BY 1, 2""")
def am24_content(spark: SparkSession, sf: str) -> DataFrame:
    Inputs(spark, sf).events.createOrReplaceTempView("events")
    episodes, _ = Mm.recorded(spark.sql(RECORDED).where("idempotency_key IS NULL"))
    return episodes.groupBy("title", F.col("confidence").cast("double").alias("confidence"), "content").agg(F.count("*").alias("n"))


@query("f14_nested_secrets", """
SELECT event_id, path, family FROM events, (VALUES
 ('view', '$.a.b[0].api_key', 'key'), ('view', '$.a.b[1]', 'auth'), ('click', '$.a.list[0][1].note', 'assignment'), ('purchase', '$', 'dsn'), ('signup', '$.user_token', 'key')) v(kind, path, family)
WHERE event_type = kind""")
def f14_nested(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    text = (F.when(kind == "view", '{"a": {"b": [{"api_key": {"deep": [1]}, "n": 1}, "Bearer abc", "fine"], "pattern": "password=x"}}')
            .when(kind == "click", '{"a": {"list": [[1, {"note": "passwd: \\"x y\\"", "pattern": {"more": true}}]]}, "e": {}}')
            .when(kind == "purchase", "not json, redis://u:p@h").when(kind == "signup", F.concat(F.lit('{"user_token": null, "p": '), "props", F.lit("}")))
            .otherwise(F.col("props")))
    return secrets_in(Inputs(spark, sf).events.select("event_id", text.alias("text")), "event_id")


@query("f15_quality_rules", oracle("""
SELECT 'relations' AS table_name, 'confidence_range' AS rule, count(CASE WHEN NOT coalesce(confidence BETWEEN 0.94 AND 1, false) THEN 1 END) AS violations FROM g_relations
UNION ALL SELECT 'relations', 'distinct_ends', count(CASE WHEN source_entity_id = target_entity_id THEN 1 END) FROM g_relations
UNION ALL SELECT 'relations', 'review_domain', count(CASE WHEN review_state NOT IN ('unreviewed', 'approved') THEN 1 END) FROM g_relations""", "g_relations"))
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return G.quality_report("relations", Inputs(spark, sf).g_relations, {
        "confidence_range": F.col("confidence").between(0.94, 1.0), "distinct_ends": F.col("source_entity_id") != F.col("target_entity_id"),
        "review_domain": F.col("review_state").isin("unreviewed", "approved")})


@query("f15_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def f15_dup(spark: SparkSession, sf: str) -> DataFrame:
    return G.duplicate_keys(Inputs(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


@query("f15_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def f15_orphans(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    return t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("ag17_st7_request_metrics", oracle(
    "SELECT method, path, status, count(*) AS requests, round(sum(latency), 4) AS latency_sum FROM request_log GROUP BY 1, 2, 3", "request_log"))
def ag17(spark: SparkSession, sf: str) -> DataFrame:
    return G.request_metrics(Inputs(spark, sf).request_log).withColumn("latency_sum", F.round("latency_sum", 4))


TIMELINE = "SELECT *, epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM stage_events"


@query("st9_stage_timeline", oracle(f"SELECT job_id, event_id, stage, round(us / 1000000.0, 3) AS seconds FROM ({TIMELINE}) t", "stage_events"))
def st9(spark: SparkSession, sf: str) -> DataFrame:
    out = G.stage_timeline(Inputs(spark, sf).stage_events, F.date_trunc("day", "ts"))
    return out.select("job_id", "event_id", "stage", F.round("seconds", 3).alias("seconds"))


@query("st3_stuck_work", oracle(f"SELECT job_id, event_id, stage FROM ({TIMELINE}) t WHERE stage NOT IN ('complete', 'failed') AND us > 900000000", "stage_events"))
def st3(spark: SparkSession, sf: str) -> DataFrame:
    return G.stuck_work(G.stage_timeline(Inputs(spark, sf).stage_events, F.date_trunc("day", "ts"))).select("job_id", "event_id", "stage")


@query("st3_job_condition", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'none' WHEN o_custkey > 1000 THEN 'attempts exhausted'
 WHEN o_orderstatus = 'P' AND o_orderdate + INTERVAL 300 DAY < TIMESTAMP '1999-01-01' THEN 'lease expired' WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 900 SECOND THEN 'no update'
 WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 1800 SECOND THEN 'dispatch stale' ELSE 'none' END AS condition FROM orders""")
def st3_jobs(spark: SparkSession, sf: str) -> DataFrame:
    o = Inputs(spark, sf).orders
    jobs = o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").otherwise("queued").alias("status"),
        F.col("o_orderdate").alias("updated_at"), (F.col("o_orderdate") + F.expr("INTERVAL 300 DAYS")).alias("lease_expires_at"),
        F.col("o_orderdate").alias("dispatched_at"), F.when(F.col("o_custkey") > 1000, 5).otherwise(1).alias("attempt"), F.lit(5).alias("max_attempts"))
    return G.job_condition(jobs, F.lit("1999-01-01").cast("timestamp")).select("o_orderkey", "condition")


# Scalars -----------------------------------------------------------------

NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


@query("x1_normalize_name", f"SELECT c_custkey, {NORM.format(chr(39) + '  ' + chr(39) + ' || c_name || ' + chr(39) + '   OF ' + chr(39) + ' || c_mktsegment')} AS name FROM customer")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "c_name", F.lit("   OF "), "c_mktsegment")
    return Inputs(spark, sf).customer.select("c_custkey", X.normalize_name(raw).alias("name"))


@query("x2_stable_ids", "SELECT c_custkey, 'ent_' || substr(sha256(concat_ws(chr(31), 'p1', c_name, CAST(c_nationkey AS VARCHAR))), 1, 32) AS id FROM customer")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).customer.select("c_custkey", X.stable_id("ent", F.lit("p1"), F.col("c_name"), F.col("c_nationkey")).alias("id"))


@query("x4_pattern_key", f"SELECT event_id, {KEY.format(chr(39) + '--' + chr(39) + ' || event_type || ' + chr(39) + ' Failure #' + chr(39) + ' || CAST(user_id AS VARCHAR) || ' + chr(39) + '!' + chr(39))} AS k FROM events")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("--"), "event_type", F.lit(" Failure #"), F.col("user_id").cast("string"), F.lit("!"))
    return Inputs(spark, sf).events.select("event_id", X.pattern_key(raw).alias("k"))


@query("x5_sanitize_error", """
SELECT event_id, 'bad Password=[redacted] and token=[redacted] at ' || event_type AS message FROM events""")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" bad   Password=p"), F.col("user_id").cast("string"), F.lit(" and token=abc\n at "), "event_type")
    return Inputs(spark, sf).events.select("event_id", X.sanitize_error(raw).alias("message"))


def secret_line(kind: str) -> F.Column:
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    return {
        "purchase": F.concat(F.lit("api_key="), e, F.lit(" password: p"), u, F.lit(" note ok")),
        "error": F.concat(F.lit("use postgres://u"), u, F.lit(":x@h/db now")),
        "click": F.concat(F.lit("sent Bearer abc."), e, F.lit(" fine")),
        "view": F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), e, F.lit("\n-----END PRIVATE KEY----- end")),
    }[kind]


def secret_text() -> F.Column:
    out = F.concat(F.lit("plain "), F.col("props"))
    for kind in ("purchase", "error", "click", "view"):
        out = F.when(F.col("event_type") == kind, secret_line(kind)).otherwise(out)
    return out


@query("x6_redact_text", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'api_key=[REDACTED] password: [REDACTED] note ok' WHEN 'error' THEN 'use [REDACTED] now'
 WHEN 'click' THEN 'sent Bearer [REDACTED] fine' WHEN 'view' THEN '[REDACTED] end' ELSE 'plain ' || props END AS text FROM events""")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).events.select("event_id", X.redact(secret_text()).alias("text"))


@query("x6_redact_documents", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '(?i)(\b(?:authorization|credential|cookie|private[_-]?key|ssh[_-]?key|access[_-]?key|api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|pwd|secret)\b\s*[:=]\s*)(?:"[^"]*"|''[^'']*''|[^\s,;]+)', '\1[REDACTED]', 'g'),
 '(?i)(\b(?:authorization|proxy-authorization|cookie|set-cookie|x-api-key)\s*:\s*)[^\r\n]+', '\1[REDACTED]', 'g'),
 '(?i)(\b(?:Basic|Bearer)\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'g'), '\b(?:ogm|rfr)_[A-Za-z0-9_-]+\b', '[REDACTED]', 'g'),
 '(?s)-----BEGIN [A-Z0-9 ]*(?:PRIVATE KEY|CERTIFICATE)-----.*?-----END [A-Z0-9 ]*(?:PRIVATE KEY|CERTIFICATE)-----', '[REDACTED]', 'g'),
 '(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp(?:s)?)://[^\s"'']+', '[REDACTED]', 'g'),
 '(?i)\bhttps?://[^\s/@:]+:[^\s/@]+@[^\s"'']+', '[REDACTED]', 'g')) AS text_hash FROM documents""")
def x6_docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(Inputs(spark, sf).documents.select("doc_id", "text")).select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("text_hash"))


@query("f14_secret_detection", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'assignment' WHEN 'error' THEN 'dsn' WHEN 'click' THEN 'auth' WHEN 'view' THEN 'pem' END AS family,
 event_type <> 'signup' AS map_secret FROM events""")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    text = secret_text()
    values = F.create_map(F.lit("pattern"), F.lit("password=x"), F.lit("note"), text)
    return Inputs(spark, sf).events.select("event_id", X.secret_family(text).alias("family"), X.map_has_secret(values).alias("map_secret"))


@query("f13_typed_content", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'missing rationale' WHEN 'view' THEN 'unknown colour' WHEN 'click' THEN 'invalid decision' WHEN 'signup' THEN 'unknown type' END AS error FROM events""")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    body = (F.when(F.col("event_type") == "error", F.concat(F.lit('{"decision": "d'), F.col("user_id").cast("string"), F.lit('"}')))
            .when(F.col("event_type") == "view", F.lit('{"decision": "d", "rationale": "r", "colour": 1}'))
            .when(F.col("event_type") == "click", F.lit('{"decision": "", "rationale": "r"}')).otherwise(F.lit('{"decision": "d", "rationale": "r"}')))
    kind = F.when(F.col("event_type") == "signup", "gossip").otherwise("decision")
    return Inputs(spark, sf).events.select("event_id", content_error(kind, body).alias("error"))


@query("x7_map_hash", """SELECT c_custkey, sha256('{"a":"' || c_mktsegment || '","b":"' || c_name || '"}') AS h FROM customer""")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).customer.select("c_custkey", X.map_hash(F.create_map(F.lit("b"), F.col("c_name"), F.lit("a"), F.col("c_mktsegment"))).alias("h"))


@query("x8_confidence_clamp", """
SELECT event_id, round(CASE event_type WHEN 'error' THEN 0.8 WHEN 'view' THEN 0.8 ELSE greatest(0.0, least(1.0, value / 50)) END, 6) AS confidence FROM events""")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", F.lit("true")).when(F.col("event_type") == "view", F.lit('"high"')).otherwise((F.col("value") / 50).cast("string"))
    return Inputs(spark, sf).events.select("event_id", F.round(X.extraction_confidence(raw), 6).alias("confidence"))


@query("x9_feedback_confidence", f"""
SELECT event_id, round(CASE kind WHEN 'confirm' THEN least(1.0, c + 0.1) WHEN 'reject' THEN 0.0 WHEN 'stale' THEN greatest(0.0, c - 0.2) WHEN 'verified' THEN 1.0 ELSE c END, 6) AS confidence,
 CASE kind WHEN 'reject' THEN 'rejected' WHEN 'stale' THEN 'degraded' ELSE 'open' END AS status FROM (SELECT event_id, {KIND} AS kind, least(1.0, value / 40) AS c FROM events) e""")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    e = Inputs(spark, sf).events
    kind = (F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "click", "stale")
            .when(F.col("event_type") == "signup", "verified").otherwise("correct"))
    return e.select("event_id", F.round(X.feedback_confidence(F.least(F.lit(1.0), F.col("value") / 40), kind), 6).alias("confidence"),
                    X.feedback_status(kind, F.lit("open")).alias("status"))


@query("x11_token_count", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).documents.select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query("x14_x15_symbol_ids", """
SELECT p_partkey, lang AS language, 'code_' || lang || '_' || left(regexp_replace(p_name, '[^a-zA-Z0-9_]+', '_', 'g'), 40) || '_' || substr(sha256(lang || ':src/' || p_brand || ext || ':class:' || p_name), 1, 12) AS id FROM (
 SELECT *, CASE p_type WHEN 'ECONOMY' THEN '.py' WHEN 'STANDARD' THEN '.TS' WHEN 'PROMO' THEN '.go' ELSE '.txt' END AS ext, CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'STANDARD' THEN 'typescript' WHEN 'PROMO' THEN 'go' ELSE 'generic' END AS lang FROM part) p""")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.when(F.col("p_type") == "ECONOMY", ".py").when(F.col("p_type") == "STANDARD", ".TS").when(F.col("p_type") == "PROMO", ".go").otherwise(".txt")
    path = F.concat(F.lit("/src/"), "p_brand", ext)
    lang = X.language_of(path)
    return Inputs(spark, sf).part.select("p_partkey", lang.alias("language"), X.symbol_id(lang, path, F.col("p_name"), F.lit("class")).alias("id"))


@query("x16_date_rules", """
SELECT o_orderkey, strftime(o_orderdate - INTERVAL 90 DAY, '%Y-%m-%d') AS cutoff, CAST(greatest(300, o_custkey + 60) AS BIGINT) AS lease, CAST(least(60, pow(2, least(o_custkey, 10))) AS BIGINT) AS backoff FROM orders""")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    cutoff = F.col("o_orderdate") - F.make_dt_interval(F.lit(90))
    return Inputs(spark, sf).orders.select("o_orderkey", F.date_format(cutoff, "yyyy-MM-dd").alias("cutoff"),
                                           X.lease_seconds(F.col("o_custkey")).cast("bigint").alias("lease"), X.retry_backoff(F.col("o_custkey")).alias("backoff"))


@query("x17_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return Inputs(spark, sf).events.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("x19_outcome_score", oracle("SELECT id, CAST(CASE status WHEN 'success' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM m_outcomes", "m_outcomes"))
def x19(spark: SparkSession, sf: str) -> DataFrame:
    return Inputs(spark, sf).m_outcomes.select("id", X.outcome_score(F.col("status")).alias("score"))
