"""Incremental ingest as a stream: landed pages to an upserted message table.

The stream's checkpoint stands for the watermark of each channel. Dropping
repeats within a watermark of event time is an extension of the batch form.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions import scoring
from skein.functions import text as X
from skein.sources.feeds import READERS, SCHEMAS, roots
from skein.sources.tables import VersionedTable


def landing_stream(spark: SparkSession, source: str, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMAS[source])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.json(path)
    return roots(raw) if source == "slack" else raw


def distinct_messages(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages without those repeated within the watermark; later ones than ``delay`` are dropped."""
    return messages.withWatermark("ts_dt", delay).dropDuplicatesWithinWatermark(["message_id"])


def ingest(spark: SparkSession, source: str, landing: str, target: VersionedTable, checkpoint: str, now: datetime) -> StreamingQuery:
    """Upsert all landed pages that the checkpoint hasn't seen, then stop."""

    def save(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            target.upsert(READERS[source](batch, now), [F.col("ingested_at"), F.col("message_id")])

    return landing_stream(spark, source, landing).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """A stream's messages with score and threshold, scored once as they come."""
    enriched = messages.withColumn("text_norm", X.normalize(F.col("text"))).withColumn("links_norm", X.normalize_urls(X.urls(F.col("text")))).withColumn("anchors", X.anchors(F.col("text")))
    f: Column = scoring.plain_features(F.col("channel_name"))
    joined = enriched.join(F.broadcast(channels.drop("ord")), ["source_id", "channel"])  # a configured list
    return joined.withColumn("features", f).withColumn("score", scoring.score(F.col("features")))


def channel_counts(messages: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Messages and reactions by channel and window of event time."""
    return messages.withWatermark("ts_dt", delay).groupBy(F.window("ts_dt", window), "channel").agg(F.count("*").alias("n"), F.sum("reactions_count").alias("reactions"))
