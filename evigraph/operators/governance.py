"""Retention, legal holds, idempotency, audit, deletion modes, stuck work and data-quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.asof import first_later, reachable
from evigraph.session import cut_lineage

# Statuses each retention action applies to.
RETENTION_STATES = {"archive": ("active", "open"), "delete": ("archived", "superseded", "rejected")}
HELD_TYPES = ("episode", "memory")
STALE_SECONDS = 900
IDEMPOTENCY_HOURS = 24


def held_ids(holds: DataFrame) -> DataFrame:
    return holds.filter(F.col("resource_type").isin(*HELD_TYPES)).select(F.col("resource_id").alias("id")).distinct()


def retention_candidates(episodes: DataFrame, cutoff: Column, action: str, holds: DataFrame) -> DataFrame:
    """Episodes older than the cutoff in a state the action covers, without held ones."""
    old = episodes.filter((F.col("created_at") < cutoff) & F.col("status").isin(*RETENTION_STATES[action]))
    return old.join(held_ids(holds), "id", "left_anti")


def apply_retention(episodes: DataFrame, cutoff: Column, action: str, holds: DataFrame) -> DataFrame:
    """Episode table after the action: archived in place, or removed."""
    due = retention_candidates(episodes, cutoff, action, holds).select("id")
    if action == "delete":
        return episodes.join(due, "id", "left_anti")
    return episodes.join(due.withColumn("_due", F.lit(True)), "id", "left").withColumn(
        "status", F.when(F.col("_due"), "archived").otherwise(F.col("status"))).drop("_due")


def delete_episodes(episodes: DataFrame, requests: DataFrame, holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining table, request results) for archive / invalidate / hard requests ``(id, mode)``."""
    held = held_ids(holds).withColumn("_held", F.lit(True))
    checked = requests.join(held, "id", "left").withColumn("result", F.when(
        ~F.col("mode").isin("archive", "invalidate", "hard"), "invalid mode").when((F.col("mode") == "hard") & F.col("_held"), "held").otherwise("done")).drop("_held")
    done = checked.filter("result = 'done'").select("id", "mode")
    out = episodes.join(done, "id", "left").filter(F.coalesce(F.col("mode") != "hard", F.lit(True))).withColumn(
        "status", F.when(F.col("mode") == "archive", "archived").when(F.col("mode") == "invalidate", "rejected").otherwise(F.col("status"))).drop("mode")
    return out, checked


def place_holds(requests: DataFrame, existing: DataFrame, episodes: DataFrame) -> DataFrame:
    """Result of each hold request: placed, duplicate or unknown episode."""
    key = ["resource_id", "resource_type"]
    first = requests.groupBy(*key).agg(F.min("hold_id").alias("hold_id")).select("hold_id", F.lit(True).alias("_first"))
    known = episodes.select(F.col("id").alias("resource_id"), F.lit(True).alias("_known"))
    standing = existing.select(*key).distinct().withColumn("_standing", F.lit(True))
    joined = requests.join(first, "hold_id", "left").join(known, "resource_id", "left").join(standing, key, "left")
    return joined.withColumn("result", F.when(
        (F.col("resource_type") == "episode") & F.col("_known").isNull(), "unknown episode").when(
        F.col("_standing").isNotNull() | F.col("_first").isNull(), "duplicate").otherwise("placed")).drop("_first", "_known", "_standing")


def audit_trail(mutations: dict[str, tuple[DataFrame, str, Column, Column]]) -> DataFrame:
    """One typed event per mutation: operation → (rows, resource type, resource id, time)."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(op).alias("operation"), F.lit(kind).alias("resource_type"), rid.alias("resource_id"), at.alias("created_at"))
        for op, (df, kind, rid, at) in mutations.items()])


def idempotent_first(events: DataFrame, keys: list[str], ts: str = "ts", event_id: str = "event_id", hours: int = IDEMPOTENCY_HOURS) -> DataFrame:
    """Event that answers each request: itself, or the first one still inside its window.

    A stored key answers until ``hours`` have passed, then the next request
    stores it anew. Each request knows the one that would be stored after it
    (the first later than its window); the stored ones are those reachable from
    the key's first request. Requests with a null key part are answered by none
    and do not appear.
    """
    window = int(hours * 3600 * 1_000_000)
    rows = cut_lineage(events.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(event_id).alias("e")).dropna(subset=keys))
    following = cut_lineage(first_later(rows, keys, window))
    first = rows.groupBy(*keys).agg(F.min(F.struct("t", "e")).alias("f")).select(*keys, "f.t", "f.e")
    # Only a request that follows some other one can be stored later: the others leave before the doubling.
    targets = following.where("nt IS NOT NULL").select(*keys, F.col("nt").alias("t"), F.col("ne").alias("e")).union(first).distinct()
    path = [f"n{k}" for k in keys]
    steps = following.join(targets, [*keys, "t", "e"], "left_semi").select(
        "*", *[F.when(F.col("nt").isNotNull(), F.col(k)).alias(n) for k, n in zip(keys, path)])
    anchors = reachable(first, steps, ["t", "e", *keys], ["nt", "ne", *path])
    # As-of match in (key, window) cells: stored requests are more than a window apart, so a cell holds at most one,
    # and the answer lies in the request's cell or the one before.
    cell = F.floor(F.col("t") / window)
    near = anchors.select(*keys, F.struct("t", "e").alias("a"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    per_cell = near.groupBy(*keys, "cell").agg(F.sort_array(F.collect_list("a")).alias("stored"))
    answer = F.element_at(F.filter("stored", lambda a: a <= F.struct("t", "e")), -1)
    joined = rows.withColumn("cell", cell).join(cut_lineage(per_cell), [*keys, "cell"])
    return joined.select(*keys, F.col("e").alias(event_id), answer["e"].alias("answered_by"))


def expired_keys(stored: DataFrame, now: Column, hours: int = IDEMPOTENCY_HOURS) -> DataFrame:
    return stored.filter(F.col("created_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))


# Work in progress --------------------------------------------------------


def stage_timeline(events: DataFrame, bucket: Column) -> DataFrame:
    """Seconds each stage lasted: the gap to the job's next event.

    Gaps are taken inside (job, bucket) pieces; the last event of a piece is
    joined to the first event of the job's next piece.
    """
    order = F.struct("ts", "event_id")
    b = events.withColumn("_b", bucket)
    inside = Window.partitionBy("job_id", "_b").orderBy("ts", "event_id")
    firsts = b.groupBy("job_id", "_b").agg(F.min(order).alias("_f"))
    chain = Window.partitionBy("job_id").orderBy("_b")
    nxt = firsts.select("job_id", "_b", F.lead("_f.ts").over(chain).alias("_next_piece"))
    out = b.withColumn("_next", F.lead("ts").over(inside)).join(nxt, ["job_id", "_b"])
    until = F.coalesce("_next", "_next_piece")
    return out.withColumn("seconds", (F.unix_micros(until) - F.unix_micros("ts")) / F.lit(1e6)).drop("_b", "_next", "_next_piece")


def stuck_work(timeline: DataFrame, stale_seconds: int = STALE_SECONDS, done: tuple[str, ...] = ("complete", "failed")) -> DataFrame:
    """Unfinished stages that saw no update for longer than the limit."""
    return timeline.filter(~F.col("stage").isin(*done) & (F.col("seconds") > stale_seconds))


def job_condition(jobs: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """What recovery a job needs: ``jobs(status, updated_at, lease_expires_at, dispatched_at, attempt, max_attempts)``."""
    gap = lambda c: F.unix_micros(now) - F.unix_micros(F.col(c).cast("timestamp"))
    limit = stale_seconds * 1_000_000
    running, queued = F.col("status") == "running", F.col("status") == "queued"
    return jobs.withColumn("condition", F.coalesce(
        F.when(~running & ~queued, "none"),
        F.when(F.col("attempt") >= F.col("max_attempts"), "attempts exhausted"),
        F.when(running & (F.col("lease_expires_at").cast("timestamp") < now), "lease expired"),
        F.when(running & (gap("updated_at") > limit), "no update"),
        F.when(queued & (gap("dispatched_at") > 2 * limit), "dispatch stale"), F.lit("none")))


def request_metrics(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "path", "status").agg(F.count("*").alias("requests"), F.sum("latency").alias("latency_sum"))


# Data quality ------------------------------------------------------------


def quality_report(table: str, df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of each rule in one pass; a null condition counts as a violation."""
    counts = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    return counts.select(F.lit(table).alias("table_name"), pairs.alias("r")).select("table_name", "r.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")
