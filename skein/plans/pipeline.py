"""The stages of a run over stored tables, and the chain of tasks that drives them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import events as E
from skein.operators import candidates as C
from skein.operators import dedup, digest, extract
from skein.operators import state as S

#: What follows each task type.
CHAIN = {"ingest": "extraction", "extraction": "llm", "llm": "dedup", "dedup": "digest", "digest": None}


@dataclass
class Settings:
    model: str = "gpt-5-nano"
    daily_budget: float = 10.0
    batch: int = 50
    lookback: timedelta = timedelta(days=7)
    digest_window: timedelta = timedelta(hours=24)
    min_confidence: float = 0.7
    max_events: int | None = 10
    cache_days: int | None = 21


def build(messages: DataFrame, known: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new candidates, statistics) of messages without a candidate; messages below the threshold are scored again next time."""
    fresh = C.unprocessed(messages, known)
    scored = C.score_messages(fresh, channels)
    return C.select_candidates(scored), C.candidate_stats(fresh, scored)


def extract_batch(
    known: DataFrame, calls: DataFrame, registry: DataFrame, extractor: extract.Extractor, settings: Settings, now: datetime, spent: float
) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(candidates after the lease, answered prompts, events), or None if the day's budget is spent."""
    allowed = C.gate(spent, settings.daily_budget)
    if allowed == "stop":
        return None
    least = C.score_cut(known).first()[0] if allowed == "best" else None
    leased = C.lease(known, now, settings.batch, least)
    ttl = S.cache_ttl(settings.cache_days)
    none = known.sparkSession.createDataFrame([], "prompt_hash string, response_json string")
    cached = none if ttl is None else S.cached_reply(calls, now, ttl)
    answered = extract.replies(extract.prompts(leased.where("leased"), settings.model), extractor, cached)
    return leased, answered, extract.to_events(answered, registry, now)


def deduplicate(events: DataFrame, now: datetime, settings: Settings, source: str | None = None, overwrite: bool = True) -> DataFrame:
    """Events of the lookback after merging.

    ``overwrite`` returns the merged set alone, else the stored events with the
    merged ones put in by id, absorbed ones included.
    """
    some = events.where(F.col("extracted_at") >= F.lit(now - settings.lookback))
    if source is not None:
        some = some.where(F.col("source_id") == source)
    merged = dedup.deduplicate(some)
    if overwrite:
        return merged
    return S.upsert(events.select(*merged.columns), merged, ["event_id"])


def validation_report(events: DataFrame) -> DataFrame:
    """(issue, n): what is wrong with how many events after a merge; it only reports, no event is dropped."""
    return events.select(F.explode(E.all_issues()).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def publish(events: DataFrame, now: datetime, settings: Settings) -> DataFrame:
    chosen = digest.digest_events(events, now - settings.digest_window, now, settings.min_confidence, settings.max_events)
    return digest.blocks(chosen, digest.header_text(now))


def schedule(tasks: DataFrame, now: datetime, with_digest: bool = False) -> DataFrame:
    """The tasks of one tick, keyed by its time so that a repeated tick adds none."""
    spark: SparkSession = tasks.sparkSession
    kinds = [("ingest", 10), ("extraction", 20), *([("digest", 90)] if with_digest else [])]
    rows = [(t, "{}", p, now, 3, f"{t}:{now:%Y%m%dT%H%M}") for t, p in kinds]
    new = spark.createDataFrame(rows, "task_type string, payload string, priority int, run_at timestamp, max_attempts int, idempotency_key string")
    return S.enqueue(tasks, new, now)[0]


def schedule_counts(tasks: DataFrame) -> DataFrame:
    """(task_type, scheduled, done) over all tasks."""
    return tasks.groupBy("task_type").agg(F.count("*").alias("scheduled"), F.count_if(F.col("status") == "done").alias("done"))


def llm_tasks(leased: DataFrame, now: datetime) -> DataFrame:
    """One task for each leased candidate."""
    return leased.where("leased").select(
        F.lit("llm").alias("task_type"), F.to_json(F.struct("message_id")).alias("payload"), F.lit(30).alias("priority"), F.lit(now).cast("timestamp").alias("run_at"),
        F.lit(3).alias("max_attempts"), F.concat(F.lit("llm:"), F.col("message_id")).alias("idempotency_key"),
    )


def backfill(days: list[date], stage: Callable[[datetime, datetime], None]) -> list[str]:
    """Run a stage a day at a time; a day that fails is reported and the others go on."""
    errors = []
    for d in days:
        start = datetime(d.year, d.month, d.day)
        try:
            stage(start, start + timedelta(days=1))
        except Exception as e:  # noqa: BLE001
            errors.append(f"{d}: {e}")
    return errors
