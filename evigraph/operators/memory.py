"""Experience store: attempts, outcomes, patterns, feedback, supersession, search and graph view."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evigraph.functions.content import content_error
from evigraph.functions.scalars import (
    feedback_status, is_promoted, outcome_score, pattern_key, redact_json, smoothed_confidence, stable_id, verifier_weight,
)
from evigraph.operators.governance import idempotent_first
from evigraph.operators.ranking import fixed_batches, top_n_per_group
from evigraph.operators.substring import matches
from evigraph.session import cut_lineage
from evigraph.sources.corpus import json_valid

OPEN_STATES = ("open", "active", "degraded")
CLOSED_STATES = ("superseded", "rejected")
# Fixed value: domains an episode may have.
DOMAINS = ("engineering", "trading", "research", "operations", "custom")
BLOCK = 1000


# Intake and attempts -----------------------------------------------------


def _json_text(df: DataFrame, column: str) -> Column:
    """A JSON column as text: maps and structs are written out, text stays."""
    return F.col(column) if df.schema[column].dataType.simpleString() == "string" else F.to_json(column)


def _is_object(text: Column) -> Column:
    return F.coalesce(json_valid(text) & F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def intake(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) episodes: typed content checked, secrets masked at every depth, defaults filled.

    ``raw`` has ``id, domain, type, title, goal, problem_signature`` and
    ``metadata`` and ``content`` as JSON text, map or struct; accepted rows keep
    them as JSON text with their types and start open at version 1.
    """
    texts = raw.withColumns({c: _json_text(raw, c) for c in ("metadata", "content")})
    content, metadata = F.col("content"), F.col("metadata")
    reason = F.coalesce(
        F.when(~F.col("domain").isin(*DOMAINS), "invalid domain"),
        F.when(content.isNotNull() & ~_is_object(content), "invalid content"),
        F.when(metadata.isNotNull() & ~_is_object(metadata), "invalid metadata"),
        F.when(F.size(F.json_object_keys(content)) > 0, content_error(F.col("type"), content)),
    )
    checked = texts.withColumn("reject_reason", reason)
    good = checked.filter("reject_reason IS NULL").drop("reject_reason").select(
        *[c for c in raw.columns if c not in ("metadata", "content")],
        redact_json(metadata).alias("metadata"), redact_json(content).alias("content"),
        F.lit("open").alias("status"), F.lit(1).alias("version"), F.lit(0).alias("feedback_score"))
    return good, checked.filter("reject_reason IS NOT NULL")


def recorded(requests: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(episodes, answers) of observation and commit requests.

    ``requests(request_id, project_id, operation, kind, content, metadata, confidence, idempotency_key, ts)``:
    an ``observe`` is stored as it comes, a ``commit`` must hold typed content of
    its kind. Requests of one key within its window are answered by the episode
    of the first accepted one; requests without a key are stored each. Answers
    have the episode or the reason of the refusal.
    """
    observed = F.col("operation") == "observe"
    texts = requests.withColumns({c: _json_text(requests, c) for c in ("metadata", "content")})
    refusal = F.coalesce(
        F.when(~F.col("operation").isin("observe", "commit"), "unknown operation"),
        F.when(~_is_object(F.coalesce("content", F.lit("{}"))), "invalid content"),
        F.when(~_is_object(F.coalesce("metadata", F.lit("{}"))), "invalid metadata"),
        F.when(F.col("operation") == "commit", content_error(F.col("kind"), F.coalesce("content", F.lit("{}")))))
    checked = cut_lineage(texts.withColumn("refusal", refusal))
    accepted = checked.where("refusal IS NULL")
    keyed = idempotent_first(accepted.where("idempotency_key IS NOT NULL"), ["project_id", "idempotency_key"], ts, "request_id")
    first = cut_lineage(keyed.select("request_id", F.col("answered_by")).unionByName(
        accepted.where("idempotency_key IS NULL OR project_id IS NULL").select("request_id", F.col("request_id").alias("answered_by"))))
    episode = stable_id("mem", F.col("answered_by"))
    answers = checked.select("request_id", "refusal").join(first, "request_id", "left").select(
        "request_id", F.when(F.col("answered_by").isNotNull(), episode).alias("episode_id"), "answered_by", "refusal")
    stored = accepted.join(first.where("request_id = answered_by"), "request_id", "left_semi")
    episodes = stored.select(
        stable_id("mem", F.col("request_id")).alias("id"), "project_id", F.when(observed, "engineering").otherwise("custom").alias("domain"),
        F.when(observed, "custom").otherwise(F.col("kind")).alias("type"),
        F.when(observed, F.coalesce("kind", F.lit("observation"))).otherwise(F.concat(F.lit("commit: "), "kind")).alias("title"),
        F.when(observed, "observation").otherwise("committed memory").alias("goal"), F.coalesce("kind", F.lit("observation")).alias("problem_signature"),
        redact_json(F.coalesce("metadata", F.lit("{}"))).alias("metadata"), redact_json(F.coalesce("content", F.lit("{}"))).alias("content"),
        F.when(observed, 0.5).otherwise(F.coalesce("confidence", F.lit(0.5))).alias("confidence"),
        F.lit("open").alias("status"), F.lit(1).alias("version"), F.col(ts).alias("created_at"))
    return episodes, answers


def episode_evidence(episodes: DataFrame, references: str = "references") -> DataFrame:
    """One row per evidence reference of an episode."""
    return episodes.select(F.col("id").alias("episode_id"), F.posexplode(references).alias("position", "reference"))


def attempt_status(episodes: DataFrame, attempts: DataFrame, order: str = "sequence") -> DataFrame:
    """Status after all attempts. An attempt never closes an open episode, so the last one decides."""
    last = attempts.groupBy("episode_id").agg(F.max_by("result", order).alias("_last"))
    joined = episodes.join(last.withColumnRenamed("episode_id", "id"), "id", "left")
    decided = F.when(F.col("_last") == "failed", "degraded").otherwise("active")
    return joined.withColumn("status", F.when(F.col("status").isin(*OPEN_STATES) & F.col("_last").isNotNull(), decided)
                             .otherwise(F.col("status"))).drop("_last")


def episode_attempt_pages(attempts: DataFrame, page_size: int = BLOCK) -> DataFrame:
    """Ordered attempts nested per episode, in pages so that no array grows without bound."""
    page = fixed_batches(F.col("sequence"), page_size)
    return attempts.groupBy("episode_id", page.alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("sequence", "result", "action"))).alias("attempts"))


def last_success(attempts: DataFrame, value: str = "action", order: str = "sequence") -> DataFrame:
    """Actions of the last successful attempt of each episode."""
    return attempts.filter("result = 'success'").groupBy("episode_id").agg(F.max_by(value, order).alias("recommended_action"))


# Outcomes and patterns ---------------------------------------------------


def outcome_quality(outcomes: DataFrame, verifiers: DataFrame) -> DataFrame:
    """Weight of each outcome: its best passing verifier."""
    best = verifiers.groupBy("outcome_id").agg(F.max(verifier_weight(F.col("kind"), F.col("status"))).alias("quality"))
    return outcomes.join(best.withColumnRenamed("outcome_id", "id"), "id", "left").withColumn(
        "quality", F.coalesce("quality", F.lit(0.0)))


def accept_outcomes(outcomes: DataFrame, episodes: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): one outcome per episode, none for superseded or rejected ones."""
    first = outcomes.groupBy("episode_id").agg(F.min(F.struct(*order, "id")).alias("f")).select(F.col("f.id").alias("id"), F.lit(True).alias("_first"))
    state = episodes.select(F.col("id").alias("episode_id"), F.col("status").alias("_status"))
    joined = outcomes.join(first, "id", "left").join(state, "episode_id", "left")
    reason = F.coalesce(
        F.when(F.col("_status").isNull(), "unknown episode"), F.when(F.col("_status").isin(*CLOSED_STATES), "episode is closed"),
        F.when(F.col("_first").isNull(), "episode already has an outcome"))
    checked = joined.withColumn("refusal", reason).drop("_first", "_status")
    return checked.filter("refusal IS NULL").drop("refusal"), checked.filter("refusal IS NOT NULL")


def patterns(outcomes: DataFrame) -> DataFrame:
    """Pattern rows from ``outcomes(project_id, pattern_key, status, quality)``: sums are associative."""
    sums = outcomes.groupBy("project_id", "pattern_key").agg(
        F.sum("quality").alias("weighted_total"),
        F.sum(F.col("quality") * outcome_score(F.col("status"))).alias("weighted_successes"),
        F.count(F.when(F.col("quality") > 0, 1)).alias("verified_outcomes"))
    return sums.withColumn("confidence", smoothed_confidence(F.col("weighted_successes"), F.col("weighted_total"))).withColumn(
        "promoted", is_promoted(F.col("verified_outcomes"), F.col("confidence")))


def keyed_outcomes(outcomes: DataFrame, episodes: DataFrame) -> DataFrame:
    """Outcomes with project and pattern key of their episode."""
    keys = episodes.select(F.col("id").alias("episode_id"), "project_id", pattern_key(F.col("problem_signature")).alias("pattern_key"))
    return outcomes.join(keys, "episode_id")


# Feedback folds ----------------------------------------------------------


def feedback_scores(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("episode_id").agg(F.sum("score").cast("bigint").alias("feedback_score"))


def pattern_feedback(base: DataFrame, feedback: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """Weighted successes after +0.1·score per event, floored at zero after each event.

    The floor makes the running value ``total − min(−start, lowest prefix)``, so
    a key is folded from (sum, lowest prefix) of its time buckets instead of
    event by event. Scores are whole steps of 0.1, summed as integers.
    """
    piece = Window.partitionBy("pattern_key", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    steps = feedback.withColumn("_bucket", bucket).withColumn("_run", F.sum("score").over(piece))
    blocks = steps.groupBy("pattern_key", "_bucket").agg(F.sum("score").alias("_sum"), F.min("_run").alias("_low"))
    before = Window.partitionBy("pattern_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lows = blocks.withColumn("_low", F.col("_low") + F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    folded = lows.groupBy("pattern_key").agg(F.sum("_sum").alias("_sum"), F.min("_low").alias("_low"))
    start = F.col("weighted_successes")
    moved = F.greatest(start + 0.1 * F.col("_sum"), 0.1 * (F.col("_sum") - F.col("_low")))
    out = base.join(folded, "pattern_key", "left").withColumn(
        "weighted_successes", F.when(F.col("_sum").isNull(), start).otherwise(moved)).drop("_sum", "_low")
    return out.withColumn("confidence", smoothed_confidence(F.col("weighted_successes"), F.col("weighted_total"))).withColumn(
        "promoted", is_promoted(F.col("verified_outcomes"), F.col("confidence")))


_STEP = {"confirm": 0.1, "stale": -0.2}


def _compose(first: Column, second: Column) -> Column:
    """Clamped shifts ``x → min(hi, max(lo, x + add))`` are closed under composition."""
    bound = lambda x: F.least(second["hi"], F.greatest(second["lo"], x + second["add"]))
    return F.struct((first["add"] + second["add"]).alias("add"), bound(first["lo"]).alias("lo"), bound(first["hi"]).alias("hi"))


def _fold(items: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("add"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))
    return F.aggregate(items, zero, _compose)


def confidence_feedback(episodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Confidence, status, score and version after typed feedback in ``sequence`` order.

    Each event is a clamped shift; blocks of events fold to one shift, and the
    blocks of an episode fold again, so no array exceeds one block.
    ``feedback(episode_id, sequence, kind[, confidence])``.
    """
    kind = F.col("kind")
    given = F.col("confidence") if "confidence" in feedback.columns else F.lit(None).cast("double")
    fixed = F.when(kind == "reject", 0.0).when(kind == "verified", 1.0).when(kind == "correct", given)
    shift = F.when(fixed.isNotNull(), F.struct(F.lit(0.0).alias("add"), fixed.alias("lo"), fixed.alias("hi"))).otherwise(F.struct(
        F.when(kind == "confirm", _STEP["confirm"]).when(kind == "stale", _STEP["stale"]).otherwise(0.0).alias("add"),
        F.when(kind == "stale", 0.0).otherwise(-1e9).alias("lo"), F.when(kind == "confirm", 1.0).otherwise(1e9).alias("hi")))
    marked = feedback.select("episode_id", "sequence", "kind", shift.alias("shift"),
                             fixed_batches(F.col("sequence"), BLOCK).alias("block"))
    score = F.when(kind == "confirm", 1).when(kind == "reject", -1).when(kind == "verified", 2).otherwise(0)
    status = F.when(kind.isin("reject", "stale"), F.struct("sequence", feedback_status(kind, F.lit(None).cast("string")).alias("s")))
    blocks = marked.groupBy("episode_id", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("sequence", "shift"))), lambda e: e["shift"]).alias("shifts"),
        F.sum(score).alias("score"), F.max(status).alias("status"), F.count(F.when(kind == "correct", 1)).alias("versions"))
    folded = blocks.withColumn("shift", _fold(F.col("shifts"))).groupBy("episode_id").agg(
        _fold(F.transform(F.sort_array(F.collect_list(F.struct("block", "shift"))), lambda e: e["shift"])).alias("f"),
        F.sum("score").alias("_score"), F.max("status").alias("_status"), F.sum("versions").alias("_versions"))
    out = episodes.join(folded.withColumnRenamed("episode_id", "id"), "id", "left")
    moved = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.col("confidence") + F.col("f.add")))
    return (
        out.withColumn("confidence", F.coalesce(moved, F.col("confidence")))
        .withColumn("status", F.coalesce("_status.s", "status"))
        .withColumn("feedback_score", F.coalesce("_score", F.lit(0)).cast("bigint"))
        .withColumn("version", (F.lit(1) + F.coalesce("_versions", F.lit(0))).cast("bigint"))
        .drop("f", "_score", "_status", "_versions")
    )


def version_history(feedback: DataFrame) -> DataFrame:
    """Snapshot taken before each correction, numbered from 1."""
    fixes = feedback.filter("kind = 'correct'")
    block = fixes.withColumn("_b", fixed_batches(F.col("sequence"), BLOCK))
    sizes = block.groupBy("episode_id", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("episode_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("episode_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    w = Window.partitionBy("episode_id", "_b").orderBy("sequence")
    return block.withColumn("_r", F.row_number().over(w)).join(offsets, ["episode_id", "_b"]).withColumn(
        "version", (F.col("_r") + F.col("_o")).cast("bigint")).withColumn(
        "id", F.concat(F.lit("ver_"), "episode_id", F.lit("_v"), F.col("version").cast("string"))).drop("_r", "_o", "_b")


def merge_episodes(pairs: DataFrame, episodes: DataFrame) -> DataFrame:
    """Merge proposals ``(source_id, target_id)``: refusal reason or the merged source row."""
    side = episodes.select("id", "project_id", "type", "content", "confidence", "version")
    s = side.select(*[F.col(c).alias(f"s_{c}") for c in side.columns]).withColumnRenamed("s_id", "source_id")
    t = side.select(*[F.col(c).alias(f"t_{c}") for c in side.columns]).withColumnRenamed("t_id", "target_id")
    joined = pairs.join(s, "source_id").join(t, "target_id", "left")
    refusal = F.coalesce(
        F.when(F.col("t_project_id").isNull(), "target not found"),
        F.when(F.col("t_project_id") != F.col("s_project_id"), "different project"),
        F.when(F.col("t_type") != F.col("s_type"), "different type"), F.when(F.col("source_id") == F.col("target_id"), "same episode"))
    return joined.select(
        "source_id", "target_id", refusal.alias("refusal"), F.col("t_content").alias("content"),
        F.greatest("s_confidence", "t_confidence").alias("confidence"), (F.col("s_version") + 1).alias("version"))


# Supersession ------------------------------------------------------------


def supersession_roots(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Final replacement of every item, or ``cycle``; ``links(item, replacement)`` with one row per item.

    Pointer doubling: after r rounds each pointer spans 2^r links. A chain longer
    than a span has items at every shorter distance, so when a round leaves as
    many items moving as before, all of those are on or behind a cycle.
    """
    state = cut_lineage(links.select("item", F.col("replacement").alias("to"), F.lit(1).cast("bigint").alias("hops")))
    moving = None
    for _ in range(max_rounds):
        nxt = state.select(F.col("item").alias("to"), F.col("to").alias("_far"), F.col("hops").alias("_more"))
        state = cut_lineage(state.join(nxt, "to", "left").select(
            "item", F.coalesce("_far", "to").alias("to"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
            F.col("_far").isNotNull().alias("_moved")))
        before, moving = moving, state.filter("_moved").count()
        if moving in (0, before):
            break
    else:
        raise RuntimeError(f"{moving} items still move after {max_rounds} rounds")
    return state.select("item", F.when(~F.col("_moved"), F.col("to")).alias("final"), F.col("_moved").alias("cycle"),
                        F.when(~F.col("_moved"), F.col("hops")).alias("hops"))


def supersede(requests: DataFrame, items: DataFrame, standing: DataFrame) -> DataFrame:
    """First refusal of each request ``(item, replacement)`` against ``items(id, status)`` and standing links."""
    known = items.select("id", "status")
    a = known.withColumnsRenamed({"id": "item", "status": "_si"})
    b = known.withColumnsRenamed({"id": "replacement", "status": "_sr"})
    ends = supersession_roots(standing).select(
        F.col("item").alias("replacement"), F.col("final").alias("_end"), F.col("cycle").alias("_cycle"))
    joined = requests.join(a, "item", "left").join(b, "replacement", "left").join(ends, "replacement", "left")
    return joined.withColumn("refusal", F.coalesce(
        F.when(F.col("_si").isNull() | F.col("_sr").isNull(), "not found"),
        F.when(F.col("item") == F.col("replacement"), "supersedes itself"),
        F.when((F.col("_si") == "superseded") | (F.col("_sr") == "superseded"), "already superseded"),
        F.when(F.coalesce("_cycle", F.lit(False)) | F.coalesce(F.col("_end") == F.col("item"), F.lit(False)), "cycle"),
    )).select("item", "replacement", "refusal")


def dangling_links(links: DataFrame, items: DataFrame) -> DataFrame:
    """Links whose replacement does not exist."""
    return links.join(items.select(F.col("id").alias("replacement")), "replacement", "left_anti")


# Search ------------------------------------------------------------------


def tokens(*texts: Column) -> Column:
    """Lower-cased words of several fields, in order."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return F.filter(F.split(joined, r"[^\p{L}\p{N}_]+"), lambda t: t != "")


@F.pandas_udf(DoubleType())
def _cover_density(words: pd.Series, wanted: pd.Series) -> pd.Series:
    """Sum over minimal covers of the query of weight / (1 + words inside that are not query words)."""

    def rank(doc, query):
        need = set(query)
        spots = [(i, w) for i, w in enumerate(doc) if w in need]
        total, left, counts = 0.0, 0, {}
        for right, (pos, word) in enumerate(spots):
            counts[word] = counts.get(word, 0) + 1
            if len(counts) < len(need):
                continue
            while counts[spots[left][1]] > 1:
                counts[spots[left][1]] -= 1
                left += 1
            gap = (pos - spots[left][0]) - (right - left)
            total += 0.1 / (1 + gap)
            counts.pop(spots[left][1])
            left += 1
        return total

    return pd.Series([rank(d, q) for d, q in zip(words, wanted)])


def search(
    queries: DataFrame, episodes: DataFrame, outcomes: DataFrame, pattern_rows: DataFrame, attempts: DataFrame,
    limit: int = 25, include_inactive: bool = False, fallback_words: int | None = None,
) -> DataFrame:
    """Ranked episodes per query with pattern, lesson and last successful action.

    ``queries(query_id, q[, problem_signature, repository, environment])`` may be
    of any size. Episodes are exploded to (word, episode) and joined on the
    query's words, so the work follows the matches; queries that find nothing so
    go to the n-gram index.
    """
    for c in ("problem_signature", "repository", "environment"):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.lit(None).cast("string"))
    asked = queries.select(
        "query_id", "q", F.array_distinct(tokens(F.col("q"))).alias("_want"), F.col("problem_signature").alias("_sig"),
        F.col("repository").alias("_repo"), F.col("environment").alias("_env"))
    active = episodes if include_inactive else episodes.filter(~F.col("status").isin(*CLOSED_STATES))
    base = active.withColumn("_words", tokens(F.col("title"), F.col("goal"), F.col("problem_signature")))
    posting = base.select(F.col("id"), F.explode(F.array_distinct("_words")).alias("_w"))
    seen = posting.groupBy("_w").agg(F.count("*").alias("_seen"))
    # A query is looked up by its rarest word; the others are tested on the episode.
    rarest = asked.select("query_id", F.explode("_want").alias("_w")).join(seen, "_w", "left").groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("_seen", F.lit(0)).alias("n"), "_w")).alias("r")).filter("r.n > 0").select("query_id", "r._w")
    hits = posting.join(cut_lineage(rarest), "_w").select("query_id", "id")
    found = hits.join(base, "id").join(asked, "query_id").filter(
        (F.size(F.array_except("_want", "_words")) == 0) & (F.col("_sig").isNull() | (F.col("problem_signature") == F.col("_sig")))
        & (F.col("_repo").isNull() | (F.col("repository") == F.col("_repo")))
        & (F.col("_env").isNull() | (F.col("environment") == F.col("_env"))))
    found = with_pattern(found, outcomes, pattern_rows)
    # One word: every occurrence is a cover of its own, so the rank needs no Python.
    single = 0.1 * F.size(F.filter("_words", lambda w: w == F.element_at("_want", 1)))
    several = _cover_density(F.when(F.size("_want") > 1, F.col("_words")).otherwise(F.array()), F.when(F.size("_want") > 1, F.col("_want")).otherwise(F.array()))
    rank = F.when(F.size("_want") == 1, single).otherwise(several)
    bonus = (
        F.when(F.col("problem_signature") == F.coalesce("_sig", "q"), 2.0).otherwise(0.0)
        + F.when(F.col("_repo").isNotNull(), 0.25).otherwise(0.0) + F.when(F.col("_env").isNotNull(), 0.25).otherwise(0.0)
        + F.when(F.col("promoted"), 0.5).otherwise(0.0) + F.coalesce("pattern_confidence", F.lit(0.0)))
    strict = found.withColumn("score", rank + bonus).select(
        "query_id", "id", "created_at", "score", "pattern_key", "pattern_confidence", "promoted", "lesson")
    strict = cut_lineage(strict)

    # Queries without a strict hit look for any of their (first ``fallback_words``) words of two or more characters as a substring.
    words = F.filter(F.split(F.lower("q"), r"(?U)\s+"), lambda w: F.char_length(w) > 1)
    if fallback_words is not None:
        words = F.slice(words, 1, fallback_words)
    missed = queries.join(strict.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode(words).alias("term"))
    texts = active.select("id", "created_at", F.lower(F.concat_ws("\n", "title", "goal", "problem_signature")).alias("text"))
    # All score zero, so time and id rank them. A query's first hits are among the first ones of its words, so each
    # distinct word is looked up once and its list cut in the map tasks, before it meets the queries that share the
    # word. An id found at several places or by several words has one dense rank.
    missed = cut_lineage(missed)

    def newest(hits: DataFrame, key: str) -> DataFrame:
        place = F.dense_rank().over(Window.partitionBy(key).orderBy(F.col("created_at").desc(), "id"))
        return hits.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place").distinct()

    listed = newest(matches(texts, missed.select(F.col("term").alias("query_id"), "term")), "query_id").withColumnRenamed("query_id", "term")
    top = newest(missed.distinct().join(listed, "term").select("query_id", "id", "created_at"), "query_id")
    loose = top.select("query_id", "id").join(active, "id")
    loose = with_pattern(loose, outcomes, pattern_rows).select(
        "query_id", "id", "created_at", F.lit(0.0).alias("score"), "pattern_key", "pattern_confidence", "promoted", "lesson")
    ranked = top_n_per_group(
        strict.unionByName(loose), ["query_id"], [F.round("score", 9).desc(), F.col("created_at").desc(), F.col("id")], limit, "rank")
    return ranked.join(last_success(attempts).withColumnRenamed("episode_id", "id"), "id", "left")


def with_pattern(episodes: DataFrame, outcomes: DataFrame, pattern_rows: DataFrame) -> DataFrame:
    """Episode ⟕ outcome ⟕ pattern."""
    o = outcomes.select(F.col("episode_id").alias("id"), "pattern_key", "lesson")
    p = pattern_rows.select("project_id", "pattern_key", F.col("confidence").alias("pattern_confidence"), "promoted")
    return episodes.join(o, "id", "left").join(p, ["project_id", "pattern_key"], "left")


def retrieval_audit(results: DataFrame) -> DataFrame:
    """What each search returned, ids only, without the query text. At most ``limit`` rows per query by construction."""
    return results.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("episode_id"), "pattern_key"))).alias("results")).withColumn(
        "query", F.lit("[redacted]"))


# Graph view --------------------------------------------------------------


def memory_graph(
    episodes: DataFrame, attempts: DataFrame, outcomes: DataFrame, pattern_rows: DataFrame, verifiers: DataFrame,
    evidence: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over the given episodes and everything attached to them."""
    ids = episodes.select(F.col("id").alias("episode_id"))
    att = attempts.join(ids, "episode_id", "left_semi")
    out = outcomes.join(ids, "episode_id", "left_semi")
    ver = verifiers.join(out.select(F.col("id").alias("outcome_id")), "outcome_id", "left_semi")
    evi = evidence.join(ids, "episode_id", "left_semi")
    pat = pattern_rows.join(out.select("pattern_key").distinct(), "pattern_key", "left_semi").withColumn("id", F.concat(F.lit("pat-"), "pattern_key"))

    def node(df: DataFrame, kind: str, label: Column, status: str | None) -> DataFrame:
        return df.select("id", F.lit(kind).alias("type"), label.alias("label"), (F.col(status) if status else F.lit(None).cast("string")).alias("status"))

    nodes = [
        node(episodes, "episode", F.col("title"), "status"),
        node(att, "attempt", F.concat(F.lit("#"), F.col("sequence").cast("string"), F.lit(": "), F.left("hypothesis", F.lit(60))), "result"),
        node(out, "outcome", F.concat("status", F.lit(": "), F.left("summary", F.lit(60))), "status"),
        node(pat, "pattern", F.col("pattern_key"), None),
        node(ver, "verifier", F.concat("kind", F.lit(": "), "name"), "status"),
        node(evi, "evidence", F.left("reference", F.lit(80)), None),
    ]

    def edge(df: DataFrame, kind: str, prefix: str, source: str, target: str) -> DataFrame:
        return df.select(F.concat_ws("-", F.lit(prefix), source, target).alias("id"), F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("type"))

    edges = [
        edge(att, "has_attempt", "eat", "episode_id", "id"), edge(out, "has_outcome", "eou", "episode_id", "id"),
        edge(out.join(pat.select("pattern_key", F.col("id").alias("pattern_id")), "pattern_key"), "matches_pattern", "omp", "id", "pattern_id"),
        edge(ver, "verified_by", "ovr", "outcome_id", "id"), edge(evi, "has_evidence", "eev", "episode_id", "id"),
    ]
    if "superseded_by_id" in episodes.columns:
        sup = episodes.join(episodes.select(F.col("id").alias("superseded_by_id")), "superseded_by_id", "left_semi")
        edges.append(edge(sup, "supersedes", "sup", "id", "superseded_by_id"))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)




def supersede_direct(requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """Supersession through feedback, which checks existence, project and self only: refusal or new status."""
    a = episodes.select(F.col("id").alias("item"), F.col("project_id").alias("_pa"), "status")
    b = episodes.select(F.col("id").alias("replacement"), F.col("project_id").alias("_pb"))
    joined = requests.join(a, "item").join(b, "replacement", "left")
    refusal = F.coalesce(
        F.when(F.col("_pb").isNull(), "not found"), F.when(F.col("_pa") != F.col("_pb"), "different project"),
        F.when(F.col("item") == F.col("replacement"), "supersedes itself"))
    return joined.select("item", "replacement", refusal.alias("refusal"), F.when(refusal.isNull(), "superseded").otherwise(F.col("status")).alias("status"))
