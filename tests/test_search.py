"""The substring index and as-of matches against plain versions."""

import random

from evigraph.operators import memory as Mm
from evigraph.operators.asof import first_later, reachable
from evigraph.operators.substring import containing, pieces


def test_containing_equals_plain_search(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab é🎉%_") for _ in range(n))
    texts = [(i % 45, word(rng.randrange(0, 30))) for i in range(60)] + [(90, None), (91, "")]
    terms = [(f"q{i}", word(rng.choice([1, 2, 3, 4, 7]))) for i in range(80)] + [("none", None), ("empty", ""), ("q0", "zz")]
    got = containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "query_id string, term string")).collect()
    want = {(q, i) for q, term in terms if term for i, t in texts if t is not None and term in t}
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
    assert containing(spark.createDataFrame([], "id int, text string"), spark.createDataFrame(terms, "query_id string, term string")).count() == 0


def test_pieces_grow_with_the_texts(spark):
    # Numbered names share all their three-character runs; the pieces that meet the terms must not grow with the square.
    counts = []
    for n in (300, 1200):
        names = spark.range(1000, 1000 + n).selectExpr("id", "'customer ' || id AS text", "'customer ' || id AS term")
        counts.append(pieces(names.select("id", "text"), names.select("term")).count())
    assert counts == [300, 1200]


def test_first_later_equals_plain_search(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xxxy"), rng.randrange(300), i) for i in range(500)]
    got = {(r["k"], r["t"], r["e"]): (r["nt"], r["ne"]) for r in first_later(spark.createDataFrame(rows, "k string, t long, e long"), ["k"], 20).collect()}
    for k, t, e in rows:
        assert got[k, t, e] == min(((t2, e2) for k2, t2, e2 in rows if k2 == k and t2 > t + 20), default=(None, None))


def test_reachable_follows_long_paths(spark):
    steps = spark.range(1000).selectExpr("id AS a", "CASE WHEN id < 990 THEN id + 7 END AS b")
    got = {r["a"] for r in reachable(spark.createDataFrame([(3,)], "a long"), steps, ["a"], ["b"]).collect()}
    assert got == set(range(3, 997, 7))


def test_loose_hits_are_cut_before_the_joins(spark, monkeypatch):
    # A word of every title: only the newest episodes of a query, ties by id, may reach the outcome and pattern joins.
    episodes = spark.range(300).selectExpr(
        "concat('e', id) AS id", "'p1' AS project_id", "'wordy wording' AS title", "'goal' AS goal", "'sig' AS problem_signature", "'repo' AS repository",
        "'dev' AS environment", "'open' AS status", "timestamp_seconds(id DIV 2) AS created_at")
    outcomes = spark.createDataFrame([], "episode_id string, pattern_key string, lesson string")
    patterns = spark.createDataFrame([], "project_id string, pattern_key string, confidence double, promoted boolean")
    attempts = spark.createDataFrame([], "episode_id string, sequence long, result string, action string")
    queries = spark.createDataFrame([("a", "word ordi"), ("b", "nowhere")], "query_id string, q string")
    joined, plain = [], Mm.with_pattern

    def counting(rows, *tables):
        joined.append(rows.count())
        return plain(rows, *tables)

    monkeypatch.setattr(Mm, "with_pattern", counting)
    got = Mm.search(queries, episodes, outcomes, patterns, attempts, limit=5).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [("a", e) for e in ("e298", "e299", "e296", "e297", "e294")]
    assert joined == [0, 5]


def test_every_word_of_a_query_is_looked_for(spark):
    # The sixth word is the only one that any episode holds; a word shared by many queries meets the episodes once.
    episodes = spark.range(300).selectExpr(
        "concat('e', id) AS id", "'p1' AS project_id", "concat('wordy ', id) AS title", "'goal' AS goal", "'sig' AS problem_signature", "'repo' AS repository",
        "'dev' AS environment", "'open' AS status", "timestamp_seconds(id DIV 2) AS created_at")
    outcomes = spark.createDataFrame([], "episode_id string, pattern_key string, lesson string")
    patterns = spark.createDataFrame([], "project_id string, pattern_key string, confidence double, promoted boolean")
    attempts = spark.createDataFrame([], "episode_id string, sequence long, result string, action string")
    queries = spark.range(3).selectExpr("concat('q', id) AS query_id", "concat('aa bb cc dd ee word 2', id, ' word') AS q")
    whole = Mm.retrieval_audit(Mm.search(queries, episodes, outcomes, patterns, attempts, limit=3)).orderBy("query_id").collect()
    assert [[x["episode_id"] for x in r["results"]] for r in whole] == [["e298", "e299", "e296"]] * 3
    first = Mm.search(queries, episodes, outcomes, patterns, attempts, limit=3, fallback_words=5)
    assert first.count() == 0


def test_the_audit_has_no_word_limit(spark):
    from evigraph.plans import memory

    asked = []
    plain = Mm.search
    try:
        Mm.search = lambda *args, **named: asked.append(named) or plain(*args, **named)
        memory.am8(spark, "/root/testdata/sf0.001")
    finally:
        Mm.search = plain
    assert asked == [{"fallback_words": None}]
