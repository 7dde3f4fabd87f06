import datetime as dt
import random

from pyspark.sql import functions as F

from evigraph.operators import governance as G
from evigraph.operators import memory as Mm


def test_cover_density_for_several_words(spark):
    df = spark.createDataFrame([(["a", "x", "b", "a"], ["a", "b"]), (["a", "b"], ["a", "b"]), (["a"], ["a", "b"])], "w array<string>, q array<string>")
    got = [round(r[0], 6) for r in df.select(Mm._cover_density("w", "q")).collect()]
    # a x b (one word between) and b a (adjacent); one cover; none.
    assert got == [round(0.1 / 2 + 0.1, 6), 0.1, 0.0]


def _answers(rows, hours=24):
    out, anchor = {}, {}
    for key, ts, e in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in anchor or ts - anchor[key][0] > dt.timedelta(hours=hours):
            anchor[key] = (ts, e)
        out[e] = anchor[key][1]
    return out


def test_idempotency_hot_and_normal_keys(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("aaab"), start + dt.timedelta(minutes=rng.randrange(0, 12000)), i) for i in range(400)]
    rows += [("c", start, 900), ("c", start + dt.timedelta(hours=24), 901), ("c", start + dt.timedelta(hours=24, seconds=1), 902)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, event_id int")
    want = _answers(rows)
    got = {r.event_id: r.answered_by for r in G.idempotent_first(df, ["k"]).collect()}
    assert got == want
    short = {r.event_id: r.answered_by for r in G.idempotent_first(df, ["k"], hours=1).collect()}
    assert short == _answers(rows, 1)
    assert G.idempotent_first(df.where("false"), ["k"]).count() == 0


def test_confidence_fold_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(Mm, "BLOCK", 7)
    rng = random.Random(2)
    events = [("e", i, rng.choice(["confirm", "stale", "stale", "confirm", "correct", "verified", "reject"]), rng.choice([None, 0.4])) for i in range(1, 120)]
    c, status, score, version = 0.8, "open", 0, 1
    for _, _, kind, given in events:
        if kind == "confirm":
            c, score = min(1.0, c + 0.1), score + 1
        elif kind == "stale":
            c, status = max(0.0, c - 0.2), "degraded"
        elif kind == "reject":
            c, status, score = 0.0, "rejected", score - 1
        elif kind == "verified":
            c, score = 1.0, score + 2
        else:
            c, version = c if given is None else given, version + 1
    ep = spark.createDataFrame([("e", 0.8, "open"), ("quiet", 0.3, "open")], "id string, confidence double, status string")
    fb = spark.createDataFrame(events, "episode_id string, sequence int, kind string, confidence double")
    got = {r.id: (round(r.confidence, 9), r.status, r.feedback_score, r.version) for r in Mm.confidence_feedback(ep, fb).collect()}
    assert got == {"e": (round(c, 9), status, score, version), "quiet": (0.3, "open", 0, 1)}


def test_promotion_thresholds(spark):
    from evigraph.functions.scalars import is_promoted

    df = spark.createDataFrame([(2, 1.0), (3, 0.69), (3, 0.7)], "n int, c double")
    assert [r[0] for r in df.select(is_promoted(F.col("n"), F.col("c"))).collect()] == [False, False, True]


def test_supersession_chain_and_cycle(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("t", "x")], "item string, replacement string")
    got = {r.item: (r.final, r.cycle, r.hops) for r in Mm.supersession_roots(links).collect()}
    assert got["a"] == ("d", False, 3) and got["c"] == ("d", False, 1)
    assert got["x"][1] and got["y"][1] and got["t"][1]


def test_retention_and_holds(spark):
    old, new = dt.datetime(2023, 1, 1), dt.datetime(2024, 6, 1)
    ep = spark.createDataFrame([("1", "active", old), ("2", "open", old), ("3", "open", new), ("4", "rejected", old), ("5", "active", old)], "id string, status string, created_at timestamp")
    holds = spark.createDataFrame([("5", "episode")], "resource_id string, resource_type string")
    cut = F.lit("2024-01-01").cast("timestamp")
    assert {r.id for r in G.retention_candidates(ep, cut, "archive", holds).collect()} == {"1", "2"}
    assert {r.id: r.status for r in G.apply_retention(ep, cut, "archive", holds).collect()} == {"1": "archived", "2": "archived", "3": "open", "4": "rejected", "5": "active"}
    assert {r.id for r in G.apply_retention(ep, cut, "delete", holds).collect()} == {"1", "2", "3", "5"}
