"""Incremental state: upserts, watermarks, response cache, task queue."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``source`` put in by ``keys``.

    Of source rows with one key the last by ``order`` wins. Columns of ``keep``
    stay as they are in rows that exist. Columns that one side lacks are null.
    """
    last = latest(source, keys, order) if order else source.dropDuplicates(keys)
    if keep:
        old = target.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in keep])
        last = last.join(old, keys, "left")
        for c in keep:
            last = last.withColumn(c, F.when(F.col("_old"), F.col(f"_old_{c}")).otherwise(F.col(c)))
        last = last.drop("_old", *[f"_old_{c}" for c in keep])
    return target.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def backfill(target: DataFrame, older: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of an older table whose keys it lacks; those that it has stay as they are."""
    return target.unionByName(older.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


# Watermarks


def after_watermark(messages: DataFrame, states: DataFrame, resuming: Column | None = None) -> DataFrame:
    """Messages newer than their channel's watermark; all of a channel that is being resumed."""
    mark = states.select("channel", F.coalesce("max_processed_ts", F.lit(0.0)).alias("_mark"), F.coalesce(F.col("resume_cursor"), F.lit("")).alias("_cursor"))
    joined = messages.join(mark, "channel", "left")
    keep = (F.coalesce("_cursor", F.lit("")) != "") | (F.col("ts_num") > F.coalesce("_mark", F.lit(0.0)))
    return joined.where(keep).drop("_mark", "_cursor")


def advance(states: DataFrame, batch: DataFrame, cursors: DataFrame, now: datetime) -> DataFrame:
    """States after a batch.

    ``cursors`` has (channel, next_cursor, has_more, baseline) of the fetch. A
    channel with more to fetch keeps its watermark and notes the cursor and its
    lower bound; a finished one moves to its newest message and clears both. A
    first fetch without messages sets the watermark to ``now``.
    """
    top = batch.groupBy("channel").agg(F.max("ts_num").alias("top"))
    s = cursors.join(top, "channel", "left").join(states, "channel", "left")
    old = F.coalesce("max_processed_ts", F.lit(0.0))
    first = F.col("max_processed_ts").isNull() & F.col("top").isNull()
    moved = F.when(F.col("has_more"), old).when(first, F.lit(now.timestamp())).otherwise(F.greatest(old, F.coalesce("top", F.lit(0.0))))
    new = s.select(
        "channel", moved.alias("max_processed_ts"), F.when(F.col("has_more"), F.col("next_cursor")).alias("resume_cursor"),
        F.when(F.col("has_more"), F.col("baseline")).alias("resume_min_ts"), F.lit(now).cast("timestamp").alias("updated_at"),
    )
    return upsert(states, new, ["channel"])


def start_of(state: dict | None, now: float, lookback_hours: float = 24.0, backfill_from: float | None = None) -> float | None:
    """From when a channel is fetched: its resume bound, its watermark, or the lookback (the earlier of that and a backfill)."""
    state = state or {}
    if state.get("resume_cursor"):
        low, mark = state.get("resume_min_ts"), state.get("max_processed_ts") or 0.0
        return low if low is not None else mark or None
    if state.get("max_processed_ts"):
        return state["max_processed_ts"]
    since = now - lookback_hours * 3600
    return since if backfill_from is None else min(since, backfill_from)


def highest(messages: DataFrame, column: str) -> DataFrame:
    """The newest position of each channel."""
    return messages.groupBy("channel").agg(F.max(column).alias("top"))


def put_position(states: DataFrame, new: DataFrame, by_time: bool) -> DataFrame:
    """Positions per channel: setting the time keeps the old id where no new one is given, setting the id resets the time."""
    joined = new.alias("n").join(states.select("channel", F.col("last_processed_message_id").alias("_old")), "channel", "left")
    if by_time:
        row = joined.select("channel", "last_processed_ts", F.coalesce("last_processed_message_id", "_old").alias("last_processed_message_id"))
    else:
        row = joined.select("channel", F.lit(0.0).alias("last_processed_ts"), "last_processed_message_id")
    return upsert(states.select("channel", "last_processed_ts", "last_processed_message_id"), row, ["channel"])


# Cache of replies


def cached_reply(calls: DataFrame, now: datetime, max_age: timedelta | None) -> DataFrame:
    """(prompt_hash, response_json): the newest stored reply of each prompt, unless it is too old."""
    last = latest(calls.where("response_json is not null"), ["prompt_hash"], [F.col("ts"), F.col("id")])
    fresh = last if max_age is None else last.where(F.col("ts") >= F.lit(now - max_age))
    return fresh.select("prompt_hash", "response_json")


def expire(calls: DataFrame, now: datetime, max_age: timedelta) -> DataFrame:
    """Calls without the replies of prompts whose newest reply is too old."""
    last = latest(calls.where("response_json is not null"), ["prompt_hash"], [F.col("ts"), F.col("id")])
    old = last.where(F.col("ts") < F.lit(now - max_age)).select("prompt_hash", F.lit(True).alias("_old"))
    return _cleared(calls.join(old, "prompt_hash", "left"), F.col("_old")).drop("_old")


def invalidate(calls: DataFrame, prompt_hash: str) -> DataFrame:
    return _cleared(calls, F.col("prompt_hash") == prompt_hash)


def _cleared(calls: DataFrame, on: Column) -> DataFrame:
    return calls.withColumn("response_json", F.when(F.coalesce(on, F.lit(False)), F.lit(None).cast("string")).otherwise(F.col("response_json")))


def attach_reply(calls: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies (prompt_hash, reply) stored with the newest call of each prompt.

    The newest calls are an aggregate, so a prompt asked very often is one row
    of a join and not a sorted group.
    """
    last = calls.groupBy("prompt_hash").agg(F.max(F.struct("ts", "id"))["id"].alias("id"))
    put = last.join(replies, "prompt_hash").select(F.col("id").alias("_id"), F.col("prompt_hash").alias("_hash"), "reply")
    both = calls.join(put, calls["id"].eqNullSafe(put["_id"]) & (calls["prompt_hash"] == put["_hash"]), "left")
    return both.withColumn("response_json", F.coalesce("reply", "response_json")).drop("_id", "_hash", "reply")


def spent(calls: DataFrame, day: datetime, column: str = "cost_usd") -> DataFrame:
    """(cost): what the calls of a day cost, zero without any."""
    start = datetime(day.year, day.month, day.day)
    mine = calls.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(start + timedelta(days=1))))
    return mine.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("cost"))


def cache_ttl(days: object, default: int = 21) -> timedelta | None:
    """How long replies are kept: ``default`` days for null or nonsense; none at all for zero or less."""
    try:
        n = int(days)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        n = default
    return timedelta(days=n) if n > 0 else None


# Task queue


#: Rows of a part in which tasks and new ones meet. Keys compress so well that parts by bytes would hold millions.
PART = 200_000


def enqueue(tasks: DataFrame, new: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(all tasks, the asked-for ones): a task whose idempotency key exists isn't added, the existing one is returned, after the new.

    Tasks and new ones meet by key in parts of about PART rows each, so a part's memory doesn't grow with the tables.
    """
    parts = max(tasks.count(), new.count()) // PART + 1
    by_key = lambda df: df.repartition(parts, "idempotency_key")
    held, given = by_key(tasks), by_key(new)
    first = given.dropDuplicates(["idempotency_key"]).join(held.select("idempotency_key").hint("merge"), "idempotency_key", "left_anti")
    at = F.lit(now).cast("timestamp")
    fresh = first.select(
        F.sha1(F.concat(F.lit("task|"), F.col("idempotency_key"))).alias("task_id"), "task_type", "payload", "priority", "run_at", F.lit("queued").alias("status"), F.lit(0).alias("attempts"),
        "max_attempts", "idempotency_key", F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("locked_at"), at.alias("created_at"), at.alias("updated_at"),
    )
    met = held.join(given.select("idempotency_key").distinct().hint("merge"), "idempotency_key", "left_semi")
    asked = fresh.withColumn("place", F.lit(0)).unionByName(met.withColumn("place", F.lit(1)))
    return tasks.unionByName(fresh), asked


def lease_tasks(tasks: DataFrame, task_type: str, now: datetime, limit: int) -> DataFrame:
    """All tasks after a lease, ``leased`` marking those taken: due, by priority and then age. One writer only."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    due = tasks.where((F.col("status") == "queued") & (F.col("task_type") == task_type) & (F.col("run_at") <= F.lit(now)))
    taken = due.orderBy("priority", "run_at", "task_id").limit(limit).select("task_id", F.lit(True).alias("_taken"))
    on = F.coalesce("_taken", F.lit(False))
    at = F.lit(now).cast("timestamp")
    out = tasks.join(taken, "task_id", "left").withColumn("status", F.when(on, "in_progress").otherwise(F.col("status")))
    out = out.withColumn("attempts", F.when(on, F.col("attempts") + 1).otherwise(F.col("attempts")))
    for c in ("locked_at", "updated_at"):
        out = out.withColumn(c, F.when(on, at).otherwise(F.col(c)))
    return out.withColumn("leased", on).drop("_taken")


def finish_task(tasks: DataFrame, task_id: str, now: datetime, error: str | None = None, retry_at: datetime | None = None) -> DataFrame:
    """A task done or, with ``error``, failed: queued again if a retry time is given and attempts are left."""
    on = F.col("task_id") == task_id
    again = (F.col("attempts") < F.col("max_attempts")) if retry_at is not None and error is not None else F.lit(False)
    status = F.lit("done") if error is None else F.when(again, "queued").otherwise("failed")
    put = {
        "status": status, "last_error": F.lit(error).cast("string"), "locked_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(now).cast("timestamp"),
        "run_at": F.when(again, F.lit(retry_at).cast("timestamp")).otherwise(F.col("run_at")),
    }
    return tasks.select(*[F.when(on, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in tasks.columns])


def retry_delay(attempts: Column, jitter: Column | None = None, most: float = 300.0) -> Column:
    """Seconds to wait: doubling with each attempt up to ``most``, and the jitter; a second at least."""
    base = F.least(F.lit(most), F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
    return F.greatest(F.lit(1.0), base + F.greatest(jitter if jitter is not None else F.lit(0.0), F.lit(0.0)))


def queue_depth(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_type", "status").agg(F.count("*").alias("n"))


def too_frequent(calls: DataFrame, user: str, at: str, most: int = 3, seconds: int = 60) -> DataFrame:
    """Calls with ``allowed``: false if the user made ``most`` calls or more in the ``seconds`` before."""
    w = Window.partitionBy(user).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    return calls.withColumn("allowed", F.count("*").over(w) < most)


def new_id() -> str:
    return str(uuid.uuid4())
