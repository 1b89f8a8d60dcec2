"""From messages to scored candidates, and the leases and gates on them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scoring

#: How long a candidate may be in work before it is released.
LEASE = timedelta(minutes=15)


def unprocessed(messages: DataFrame, candidates: DataFrame, source: str | None = None) -> DataFrame:
    """Messages without a candidate yet."""
    kept = messages if source is None else messages.where(F.col("source_id") == source)
    return kept.join(candidates.select("message_id"), "message_id", "left_anti")


def with_channel(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Messages of configured channels with their channel's settings; the first of equal settings wins.

    ``channels`` is a configured list (ord gives its order), so it is a small
    side; Spark broadcasts it as long as it is below its threshold.
    """
    first = Window.partitionBy("source_id", "channel").orderBy("ord")
    settings = channels.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first", "ord")
    return messages.join(settings, ["source_id", "channel"])


def score_messages(messages: DataFrame, channels: DataFrame, feed_source: str = "slack") -> DataFrame:
    """Messages with features, score, explanations and their channel's settings.

    Messages of ``feed_source`` are scored by raw text and blocks, all others
    by normalised text.
    """
    joined = with_channel(messages, channels)
    name = F.col("channel_name")
    features = F.when(F.col("source_id") == feed_source, scoring.feed_features(name)).otherwise(scoring.plain_features(name))
    scored = joined.withColumn("features", features)
    f = F.col("features")
    return scored.withColumn("score", scoring.score(f)).withColumn("explanations", scoring.explanations(f))


def select_candidates(scored: DataFrame) -> DataFrame:
    """New candidates: those that reach their channel's threshold."""
    return scored.where(F.col("score") >= F.col("threshold_score")).select(
        "message_id", "channel", "ts_dt", "text_norm", "links_norm", "anchors", "score", F.lit("new").alias("status"), "features", "source_id",
        F.lit(0).alias("lease_attempts"), F.lit(None).cast("timestamp").alias("processing_started_at"),
    )


def candidate_stats(messages: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: messages seen, candidates made, and the scores of all scored messages."""
    of = scored.agg(
        F.count("*").alias("scored"), F.count_if(F.col("score") >= F.col("threshold_score")).alias("candidates_created"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"), F.coalesce(F.min("score"), F.lit(0.0)).alias("min_score"),
    )
    return messages.agg(F.count("*").alias("messages_processed")).join(F.broadcast(of), F.lit(True))  # one row each


def score_cut(candidates: DataFrame, limit: int = 1000, share: float = 0.1, least: int = 10) -> DataFrame:
    """(min_score): the score at index int(n * share) of the n best new candidates, ``limit`` at most; null for fewer than ``least``."""
    best = candidates.where("status = 'new'").orderBy(F.col("score").desc(), "message_id").limit(limit).select("score", "message_id")
    # the window runs over the rows of the limit only
    place = best.withColumn("i", F.row_number().over(Window.orderBy(F.col("score").desc(), "message_id")) - 1)
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    cut = place.withColumn("n", n).where((F.col("n") >= least) & (F.col("i") == F.floor(F.col("n") * share)))
    return cut.agg(F.max("score").alias("min_score"))


def lease(candidates: DataFrame, now: datetime, batch: int | None = 50, min_score: float | None = None, source: str | None = None) -> DataFrame:
    """All candidates after a lease; ``leased`` marks those taken.

    First candidates in work for longer than LEASE, or without a start, become
    new. Then the best new ones are taken: in work since ``now``, one attempt
    more. The caller must be the only writer of the table.
    """
    late = (F.col("status") == "processing") & (F.col("processing_started_at").isNull() | (F.col("processing_started_at") < F.lit(now - LEASE)))
    late = F.coalesce(late, F.lit(False))
    freed = candidates.withColumn("status", F.when(late, "new").otherwise(F.col("status"))).withColumn(
        "processing_started_at", F.when(late, F.lit(None).cast("timestamp")).otherwise(F.col("processing_started_at"))
    )
    ready = freed.where("status = 'new'")
    if min_score is not None:
        ready = ready.where(F.col("score") >= min_score)
    if source is not None:
        ready = ready.where(F.col("source_id") == source)
    taken = ready.select("message_id", "score")
    if batch is not None:
        taken = taken.orderBy(F.col("score").desc(), "message_id").limit(batch)
    out = freed.join(taken.select("message_id", F.lit(True).alias("_taken")), "message_id", "left")
    on = F.coalesce("_taken", F.lit(False))
    return (
        out.withColumn("status", F.when(on, "processing").otherwise(F.col("status")))
        .withColumn("processing_started_at", F.when(on, F.lit(now).cast("timestamp")).otherwise(F.col("processing_started_at")))
        .withColumn("lease_attempts", F.when(on, F.col("lease_attempts") + 1).otherwise(F.col("lease_attempts")))
        .withColumn("leased", on).drop("_taken")
    )


def by_message_id(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """The candidates of some messages; ``ids`` has message_id."""
    return candidates.join(ids.select("message_id").distinct(), "message_id", "left_semi")


def set_status(candidates: DataFrame, message_id: str, status: str, now: datetime) -> DataFrame:
    """One candidate's new status; entering work starts its time and counts an attempt, any other clears the time."""
    on = F.col("message_id") == message_id
    start = F.lit(now).cast("timestamp") if status == "processing" else F.lit(None).cast("timestamp")
    more = 1 if status == "processing" else 0
    return (
        candidates.withColumn("status", F.when(on, status).otherwise(F.col("status")))
        .withColumn("processing_started_at", F.when(on, start).otherwise(F.col("processing_started_at")))
        .withColumn("lease_attempts", F.when(on, F.col("lease_attempts") + more).otherwise(F.col("lease_attempts")))
    )


def gate(spent: float, budget: float) -> str:
    """What a day's spending allows: ``stop``, ``best`` (less than a fifth is left) or ``all``."""
    return "stop" if spent >= budget else "best" if budget - spent < budget * 0.2 else "all"


def call_allowed(spent: float, budget: float, cached: bool, first: bool) -> bool:
    """Whether a prompt may be sent: only a candidate's first one that isn't cached is checked against the day's budget."""
    return cached or not first or gate(spent, budget) != "stop"
