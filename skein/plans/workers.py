"""Workers of the task queue: what each type of task does to the stored tables, and what follows it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import candidates as C
from skein.operators import dedup, extract
from skein.operators import state as S
from skein.plans import pipeline
from skein.plans.pipeline import CHAIN, Settings
from skein.sources import feeds, tables
from skein.sources.tables import VersionedTable

#: Columns of a queued task.
TASK = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("task_id", T.StringType()), ("task_type", T.StringType()), ("payload", T.StringType()), ("priority", T.IntegerType()), ("run_at", T.TimestampType()), ("status", T.StringType()),
        ("attempts", T.IntegerType()), ("max_attempts", T.IntegerType()), ("idempotency_key", T.StringType()), ("last_error", T.StringType()), ("locked_at", T.TimestampType()),
        ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()),
    )]
)
Handler = Callable[[dict[str, Any], datetime], Any]


@dataclass
class Stores:
    """The tables that a run reads and writes; a table's schema is that of the step that fills it."""

    messages: VersionedTable
    candidates: VersionedTable
    calls: VersionedTable
    events: VersionedTable
    tasks: VersionedTable


def handlers(
    spark: SparkSession, stores: Stores, channels: DataFrame, registry: DataFrame, extractor: extract.Extractor, send: Callable[[list[dict]], str],
    settings: Settings = Settings(), spent: Callable[[datetime], float] = lambda now: 0.0,
) -> dict[str, Handler]:
    """What each type of task does; payloads are small JSON objects."""

    def ingest(payload: dict[str, Any], now: datetime) -> None:
        stores.messages.upsert(feeds.read_feed(spark, payload["source"], payload["path"], now))

    def build(payload: dict[str, Any], now: datetime) -> None:
        new, _ = pipeline.build(stores.messages.read(), stores.candidates.read(), channels)
        stores.candidates.upsert(new)

    def answer(payload: dict[str, Any], now: datetime) -> dict[str, Any]:
        """A batch of the best candidates, or the one that the payload names."""
        known = stores.candidates.read()
        if "message_id" in payload:
            one = spark.createDataFrame([(payload["message_id"],)], "message_id string")
            known = C.by_message_id(known, one)
            if not known.head(1):
                return {"candidates_processed": 0, "events_extracted": 0, "llm_calls": 0, "cache_hits": 0, "total_cost_usd": 0.0, "errors": []}
        found = pipeline.extract_batch(known, stores.calls.read(), registry, extractor, settings, now, spent(now))
        if found is None:
            raise extract.CallFailed("budget", "the day's budget is spent")
        leased, answered, events = found
        answered = stores_calls(answered, now)
        stores.events.upsert(events, [F.col("extracted_at"), F.col("event_id")], keep=["event_id"])
        stores.candidates.upsert(extract.finish(leased, answered))
        row = extract.metrics(answered, events, settings.model).first()
        return {**row.asDict(), "errors": [r.error for r in extract.errors(answered).limit(100).collect()]}

    def stores_calls(answered: DataFrame, now: datetime) -> DataFrame:
        """Calls as they were made, written before anything is derived from them: an answer is paid for once."""
        made = answered.where(~F.col("cached")).dropDuplicates(["prompt_hash"])
        row = made.select(
            F.sha1(F.concat(F.lit(f"{now:%Y%m%dT%H%M%S}|"), "prompt_hash")).alias("id"), "message_id", "prompt_hash", F.lit(settings.model).alias("model"), "tokens_in", "tokens_out",
            F.lit(False).alias("cached"), "response_json", F.lit(now).cast("timestamp").alias("ts"),
        )
        stores.calls.upsert(row)
        ours = stores.calls.read().where(F.col("ts") == F.lit(now)).select("prompt_hash", F.col("response_json").alias("_r"), F.col("tokens_in").alias("_in"), F.col("tokens_out").alias("_out"))
        asked = answered.drop("response_json", "tokens_in", "tokens_out", "cached")
        old = S.cached_reply(stores.calls.read().where(F.col("ts") < F.lit(now)), now, None).withColumnRenamed("response_json", "_old")
        both = asked.join(ours, "prompt_hash", "left").join(old, "prompt_hash", "left")
        zero = F.lit(0)
        return both.select(
            *asked.columns, F.coalesce("_r", "_old").alias("response_json"), F.coalesce("_in", zero).alias("tokens_in"), F.coalesce("_out", zero).alias("tokens_out"), F.col("_r").isNull().alias("cached")
        )

    def merge(payload: dict[str, Any], now: datetime) -> dict[str, int]:
        before = stores.events.read()
        stores.events.write(pipeline.deduplicate(before, now, settings, payload.get("source"), overwrite="source" not in payload).select(*before.columns))
        return dedup.dedup_counts(before, stores.events.read()).first().asDict()

    def publish(payload: dict[str, Any], now: datetime) -> list[str]:
        return tables.post(pipeline.publish(stores.events.read(), now, settings), send, payload.get("dry_run", False))

    return {"ingest": ingest, "extraction": build, "llm": answer, "dedup": merge, "digest": publish}


def work(tasks: VersionedTable, task_type: str, handler: Handler, now: datetime, limit: int = 10, follow: dict[str, str | None] = CHAIN) -> dict[str, int]:
    """Lease due tasks of a type, handle each, and queue what follows those that succeed.

    At most ``limit`` tasks pass the driver. One that fails is queued again
    after a growing wait while it has attempts left. Keys of following tasks
    derive from the task's own, so that a repetition adds none.
    """
    leased = S.lease_tasks(tasks.read(), task_type, now, limit)
    mine = leased.where("leased").orderBy("priority", "run_at", "task_id").collect()  # limit rows
    counts = {"done": 0, "failed": 0}
    if not mine:
        return counts
    tasks.write(leased.drop("leased"))
    for task in mine:
        try:
            handler(json.loads(task.payload or "{}"), now)
        except Exception as e:  # noqa: BLE001  whatever went wrong is the task's error
            wait = min(300.0, 2.0 ** max(task.attempts - 1, 0))
            tasks.write(S.finish_task(tasks.read(), task.task_id, now, str(e)[:500], now + timedelta(seconds=max(1.0, wait))))
            counts["failed"] += 1
            continue
        done = S.finish_task(tasks.read(), task.task_id, now)
        if after := follow.get(task_type):
            row = [(after, "{}", task.priority, now, task.max_attempts, f"{after}:{task.idempotency_key}")]
            new = tasks.spark.createDataFrame(row, "task_type string, payload string, priority int, run_at timestamp, max_attempts int, idempotency_key string")
            done, _ = S.enqueue(done, new, now)
        tasks.write(done)
        counts["done"] += 1
    return counts
