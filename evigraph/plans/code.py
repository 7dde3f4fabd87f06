"""Registered code-graph, evaluation and transfer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.operators import code as K
from evigraph.operators import evaluation as Ev
from evigraph.operators import extraction as E
from evigraph.plans.inputs import Inputs, oracle
from evigraph.plans.memory import keyed, sequenced_attempts
from evigraph.plans.memory import SEQ
from evigraph.plans.registry import query, with_ctes
from evigraph.session import shuffled, spread
from evigraph.sources import transfer as T

# One source file per part: a class with methods, a function inside one of them, short symbols one behind the other,
# calls after an inner function and outside all symbols.
FILES = """SELECT concat('src/m', CAST(p_size AS STRING), '/part', CAST(p_partkey AS STRING), CASE WHEN p_type = 'ECONOMY' THEN '.ts' ELSE '.py' END) AS file_path, p_partkey,
 concat('import os', chr(10), chr(10), 'class Part', CAST(p_partkey AS STRING), '(Base', CAST(p_size AS STRING), '):', chr(10),
        '    def price', CAST(p_size AS STRING), '(self):', chr(10), '        def inner(y):', chr(10), '            return deep(y)', chr(10),
        '        return helper', CAST(p_size AS STRING), '(1)', chr(10), '    def short(self): return price', CAST(p_size AS STRING), '(2)', chr(10), chr(10),
        'def helper', CAST(p_size AS STRING), '(x):', chr(10), '    return x', chr(10), 'run', CAST(p_size AS STRING), '(3)', chr(10)) AS code, p_size FROM part"""
LANG = "CASE WHEN file_path LIKE '%.ts' THEN 'typescript' ELSE 'python' END"


def sid(path: str, name: str, kind: str) -> str:
    return f"'code_' || {LANG} || '_' || left(regexp_replace({name}, '[^a-zA-Z0-9_]+', '_', 'g'), 40) || '_' || substr(sha256({LANG} || ':' || {path} || ':{kind}:' || {name}), 1, 12)"


def named(prefix: str) -> str:
    return f"'{prefix}' || CAST(p_size AS VARCHAR)"


PART = "'Part' || CAST(p_partkey AS VARCHAR)"
# Name, kind, first and last line of each symbol.
SPANS = ((PART, "class", 3, 9), (named("price"), "function", 4, 7), ("'inner'", "function", 5, 7), ("'short'", "function", 8, 9), (named("helper"), "function", 10, 12))
SYMBOLS_SQL = " UNION ALL ".join(
    f"SELECT file_path, {name} AS name, '{kind}' AS kind, CAST({first} AS BIGINT) AS start_line, CAST({last} AS BIGINT) AS end_line, {sid('file_path', name, kind)} AS id FROM files"
    for name, kind, first, last in SPANS)


FILES_PER_TASK = 100_000


def files(spark: SparkSession, sf: str) -> DataFrame:
    # The rows of part are small and their files large, so the rows are dealt out before the texts are made.
    spread(Inputs(spark, sf).part.select("p_partkey", "p_size", "p_type"), FILES_PER_TASK).createOrReplaceTempView("part")
    return spark.sql(FILES).select("file_path", "code")


@query("cg1_symbols", with_ctes(SYMBOLS_SQL, files=FILES))
def cg1(spark: SparkSession, sf: str) -> DataFrame:
    return K.symbols(files(spark, sf)).select("file_path", "name", "kind", "start_line", "end_line", "id")


@query("cg2_symbol_chunks", with_ctes(" UNION ALL ".join(
    f"SELECT file_path, CAST({i} AS BIGINT) AS chunk_index, {name} AS symbol_name, array_to_string(list_slice(string_split(code, chr(10)), {first}, {last}), chr(10)) AS text FROM files"
    for i, (name, _, first, last) in enumerate(SPANS)), files=FILES))
def cg2(spark: SparkSession, sf: str) -> DataFrame:
    return K.symbol_chunks(files(spark, sf)).select("file_path", "chunk_index", "symbol_name", "text")


# Kind, target, line and the symbol that holds it ('' for the file).
RELATIONS = (("imports", "'os'", 1, "''"), ("inherits", named("Base"), 3, PART), ("calls", "'deep'", 6, "'inner'"),
             ("calls", named("helper"), 7, named("price")), ("calls", named("price"), 8, "'short'"))


@query("cg3_text_relations", with_ctes(" UNION ALL ".join(
    f"SELECT file_path, '{kind}' AS kind, {target} AS target_name, CAST({line} AS BIGINT) AS line_number, {owner} AS owner FROM files" for kind, target, line, owner in RELATIONS), files=FILES))
def cg3(spark: SparkSession, sf: str) -> DataFrame:
    rel, owners = K.text_relations(files(spark, sf)), K.symbols(files(spark, sf)).select(F.col("id").alias("source_id"), F.col("name").alias("owner"))
    return rel.join(shuffled(owners), "source_id", "left").select("file_path", "kind", "target_name", "line_number", F.coalesce("owner", F.lit("")).alias("owner"))


@query("cg4_j10_symbol_table", with_ctes("""
SELECT n AS name, max_by(id, file_path || '|' || CAST(start_line AS VARCHAR)) AS id FROM (
 SELECT DISTINCT unnest([name, lower(name)]) AS n, id, file_path, start_line FROM syms) x GROUP BY 1""", files=FILES, syms=SYMBOLS_SQL))
def cg4(spark: SparkSession, sf: str) -> DataFrame:
    return K.symbol_table(K.symbols(files(spark, sf)))


@query("cg5_j10_code_relations", with_ctes("""
SELECT 'contains' AS relation_type, count(*) AS n FROM syms UNION ALL SELECT 'calls', 2 * count(*) FROM files""", files=FILES, syms=SYMBOLS_SQL))
def cg5(spark: SparkSession, sf: str) -> DataFrame:
    return K.code_graph(files(spark, sf))[1].groupBy("relation_type").agg(F.count("*").alias("n"))


@query("cg6_ag15_ingest_totals", with_ctes("""
SELECT count(*) AS files, CAST(count(*) * 12 AS BIGINT) AS loc, count(*) * 6 AS entities, count(*) * 7 AS relations FROM files""", files=FILES))
def cg6(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    return K.totals(f, *K.code_graph(f))


@query("src11_source_filter", """
SELECT page_id, CASE WHEN k = 'node_modules' OR e = '.min.js' OR e = '.txt' THEN false ELSE true END AS wanted FROM (
 SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'node_modules' ELSE 'src' END AS k, CASE WHEN contains(url, '?') THEN '.min.js' WHEN contains(url, '#') THEN '.txt' ELSE '.TS' END AS e FROM pages) p""")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.when(F.contains("url", F.lit("/de/")), "node_modules").otherwise("src")
    ext = F.when(F.contains("url", F.lit("?")), ".min.js").when(F.contains("url", F.lit("#")), ".txt").otherwise(".TS")
    return Inputs(spark, sf).pages.select("page_id", K.wanted_source(F.concat(F.lit("a/"), folder, F.lit("/x"), ext)).alias("wanted"))


# Evaluation --------------------------------------------------------------

GOLD = """SELECT concat('c', CAST(o_orderkey AS STRING)) AS id, o_orderstatus <> 'P' AS answerable, o_custkey FROM orders"""
EV1 = """
SELECT 'c' || CAST(o.o_orderkey AS VARCHAR) AS id, o_orderstatus <> 'P' AS answerable, w.want, p.got, p.total FROM orders o
LEFT JOIN (SELECT l_orderkey, list_distinct(list(CAST(l_partkey % 7 AS VARCHAR))) AS want FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) w ON w.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT l_orderkey, list_slice(list_sort(list_distinct(list(CAST(l_suppkey % 7 AS VARCHAR)))), 1, 3) AS got, count(*) AS total FROM lineitem GROUP BY 1) p ON p.l_orderkey = o.o_orderkey"""
EV_CASES = """
SELECT id, CASE WHEN coalesce(len(want), 0) = 0 THEN 1.0 ELSE len(list_intersect(want, coalesce(got, []))) / CAST(len(want) AS DOUBLE) END AS recall_at_k,
 CASE WHEN coalesce(len(want), 0) = 0 THEN true ELSE len(list_intersect(want, coalesce(got, []))) > 0 END AS evidence_hit,
 CASE WHEN answerable THEN coalesce(len(got), 0) > 0 ELSE coalesce(len(got), 0) = 0 END AS citation_correct,
 CASE WHEN answerable THEN coalesce(total, 0) <= 5 ELSE coalesce(total, 0) > 5 END AS unanswerable_correct, coalesce(CAST(total AS DOUBLE), 0.0) AS latency_ms FROM base"""


def cases(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """Golden cases and predictions built from orders and their line items."""
    li = t.lineitem
    oid = F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("id")
    want = li.filter("l_returnflag = 'R'").groupBy(oid).agg(F.collect_set((F.col("l_partkey") % 7).cast("string")).alias("evidence_ids"))
    golden = t.orders.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("id"), (F.col("o_orderstatus") != "P").alias("answerable")).join(
        want, "id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    got = F.sort_array(F.collect_set((F.col("l_suppkey") % 7).cast("string")))
    pred = li.groupBy(oid).agg(got.alias("retrieved"), F.count("*").alias("total")).select(
        "id", F.when(F.col("total") > 5, "I Cannot answer this").otherwise("yes").alias("answer"), "retrieved",
        F.slice("retrieved", 1, 3).alias("citations"), F.lit(False).alias("unanswerable"), F.col("total").cast("double").alias("latency_ms"),
        F.col("total").alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.lit(0.5).alias("estimated_cost_usd"))
    return golden, pred


@query("ev1_retrieval_cases", with_ctes("SELECT id, round(recall_at_k, 6) AS recall_at_k, evidence_hit, citation_correct, unanswerable_correct FROM scored", base=EV1, scored=EV_CASES))
def ev1(spark: SparkSession, sf: str) -> DataFrame:
    golden, pred = cases(Inputs(spark, sf))
    return Ev.retrieval_cases(golden, pred, 3).select("id", F.round("recall_at_k", 6).alias("recall_at_k"), "evidence_hit", "citation_correct", "unanswerable_correct")


@query("ev2_retrieval_report", with_ctes("""
SELECT count(*) AS cases, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(CAST(evidence_hit AS INT)), 6) AS evidence_hit_rate, round(avg(CAST(citation_correct AS INT)), 6) AS citation_correctness,
 round(avg(CAST(unanswerable_correct AS INT)), 6) AS unanswerable_accuracy, quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95,
 CAST(sum(latency_ms) AS BIGINT) AS prompt_tokens, count(CASE WHEN latency_ms = 0 THEN 1 END) AS missing_predictions,
 (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS extra_predictions FROM scored""", base=EV1, scored=EV_CASES))
def ev2(spark: SparkSession, sf: str) -> DataFrame:
    golden, pred = cases(Inputs(spark, sf))
    rep = Ev.retrieval_report(Ev.retrieval_cases(golden, pred, 3), golden, pred)
    shares = ("recall_at_k", "evidence_hit_rate", "citation_correctness", "unanswerable_accuracy")
    return rep.select("cases", *[F.round(c, 6).alias(c) for c in shares], "latency_p50", "latency_p95", "prompt_tokens", "missing_predictions", "extra_predictions")


PAIRS = """SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM a) AS actual, (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM a) x) AS correct"""
KEYS_SQL = {"e": "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity > 10", "a": "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_discount < 0.05"}


def key_sets(t: Inputs) -> tuple[DataFrame, DataFrame]:
    pick = lambda c: t.lineitem.filter(c).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return pick("l_quantity > 10"), pick("l_discount < 0.05")


@query("ev3_set4_precision_recall", with_ctes("""
SELECT expected, actual, correct, round(correct / CAST(actual AS DOUBLE), 6) AS precision, round(correct / CAST(expected AS DOUBLE), 6) AS recall,
 round(2.0 * (correct / CAST(actual AS DOUBLE)) * (correct / CAST(expected AS DOUBLE)) / (correct / CAST(actual AS DOUBLE) + correct / CAST(expected AS DOUBLE)), 6) AS f1 FROM n""", **KEYS_SQL, n=PAIRS))
def ev3(spark: SparkSession, sf: str) -> DataFrame:
    out = Ev.set_scores(*key_sets(Inputs(spark, sf)), ["s", "p"])
    return out.select("expected", "actual", "correct", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("ev4_provenance", with_ctes("SELECT expected, round(correct / CAST(expected AS DOUBLE), 6) AS provenance_completeness FROM n", **KEYS_SQL, n=PAIRS))
def ev4(spark: SparkSession, sf: str) -> DataFrame:
    return Ev.provenance(*key_sets(Inputs(spark, sf)), ["s", "p"]).withColumn("provenance_completeness", F.round("provenance_completeness", 6))


@query("ev4_duplicate_rate", "SELECT round((count(*) - count(DISTINCT (l_suppkey, l_partkey))) / CAST(count(*) AS DOUBLE), 6) AS duplicate_rate FROM lineitem")
def ev4_dup(spark: SparkSession, sf: str) -> DataFrame:
    return Ev.duplicate_rate(Inputs(spark, sf).lineitem, ["l_suppkey", "l_partkey"]).select(F.round("duplicate_rate", 6).alias("duplicate_rate"))


@query("ev5_unambiguous_relations", oracle("""
SELECT 'gd' || CAST(c_custkey AS VARCHAR) AS doc_id, 'LIVES_IN' AS type FROM customer UNION ALL SELECT 'gd' || CAST(c_custkey AS VARCHAR), 'PART_OF' FROM customer"""))
def ev5(spark: SparkSession, sf: str) -> DataFrame:
    docs = Inputs(spark, sf).grammar_docs
    return Ev.unambiguous_relations(E.grammar_relations(docs, ["doc_id"]), E.grammar_entities(docs, ["doc_id"]), ["doc_id"]).select("doc_id", "type")


# Transfer ----------------------------------------------------------------


def exported(t: Inputs) -> DataFrame:
    attempts = sequenced_attempts(t)
    evidence = attempts.select("episode_id", F.col("sequence").alias("position"), F.concat(F.lit("log/"), "id").alias("reference"))
    return T.export_episodes(t.m_episodes, attempts, keyed(t), evidence)


@query("src12_export", oracle("""
SELECT e.id AS episode_id, e.title, o.status AS outcome, a.results, a.n AS evidence_count FROM m_episodes e LEFT JOIN m_outcomes o ON o.episode_id = e.id
LEFT JOIN (SELECT episode_id, string_agg(result, ',' ORDER BY sequence) AS results, count(*) AS n FROM seq GROUP BY 1) a ON a.episode_id = e.id""",
    "m_episodes", "m_outcomes", "m_attempts", seq=SEQ))
def src12(spark: SparkSession, sf: str) -> DataFrame:
    return exported(Inputs(spark, sf)).select(
        "episode_id", "title", F.col("outcome.status").alias("outcome"),
        F.array_join(F.transform("attempts", lambda a: a["result"]), ",").alias("results"), F.size("evidence").cast("bigint").alias("evidence_count"))


@query("src13_import_attempts", oracle("""
SELECT episode_id, sequence, result FROM seq WHERE episode_id NOT IN (SELECT id FROM m_episodes WHERE environment = 'prod')""", "m_episodes", "m_attempts", seq=SEQ))
def src13(spark: SparkSession, sf: str) -> DataFrame:
    t = Inputs(spark, sf)
    _, attempts, _ = T.import_episodes(exported(t), t.m_episodes.filter("environment = 'prod'"), {"domain": "custom"})
    return attempts.select("episode_id", "sequence", "result")
