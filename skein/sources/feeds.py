"""Readers of landed message pages, and their rows as messages.

A fetcher lands each page of a chat API as JSON; reading is Spark's. Two feeds
are known: one with blocks and threads (``slack``), one with entities and
numeric message ids (``telegram``).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import python as P
from skein.functions import text as X

_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SLACK_RAW = _struct(
    channel=_S, ts=_S, thread_ts=_S, user=_S, bot_id=_S, subtype=_S, text=_S, blocks=_S, reply_count=_I,
    reactions=T.ArrayType(_struct(name=_S, count=_I)), attachments=T.ArrayType(_S), files=T.ArrayType(_S), edited=_struct(ts=_S, user=_S),
)
TELEGRAM_RAW = _struct(
    channel=_S, message_id=_S, date=T.TimestampType(), sender_id=_S, sender_name=_S, text=_S,
    entities=T.ArrayType(_struct(kind=_S, offset=_I, length=_I, url=_S)), media_type=_S, file_mime=_S, mime_type=_S, mimeType=_S, has_media=T.BooleanType(),
    views=_I, reply_count=_I, reactions=_S, reply_to_message_id=_S, reply_to_msg_id=_S, thread_id=_S, via_bot_id=_S, bot_id=_S, sender_bot_id=_S, is_bot=T.BooleanType(),
    forward_from_channel=_S, forward_from_message_id=_S, post_url=_S, attachments_count=_I, attachments=T.ArrayType(_S), files_count=_I, files=T.ArrayType(_S),
)
USER = _struct(user=_S, name=_S, real_name=_S, profile=_struct(real_name=_S, display_name=_S, email=_S, image_512=_S, image_192=_S, image_72=_S, image_48=_S))


def _filled(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def read_landing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed pages; a line that doesn't parse is kept in ``_corrupt_record`` and doesn't stop the others."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", _S)])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path)


def roots(raw: DataFrame, oldest: float | None = None, latest: float | None = None, limit: int | None = None) -> DataFrame:
    """Messages that start a thread, from ``oldest`` to ``latest``; with a limit the newest ones, by number, not by text."""
    n = X.lenient_number(F.col("ts"))
    kept = raw.where(F.col("thread_ts").isNull() | (F.col("thread_ts") == F.col("ts")))
    if oldest is not None:
        kept = kept.where(n >= oldest)
    if latest is not None:
        kept = kept.where(n <= latest)
    return kept if limit is None else kept.orderBy(n.desc(), "channel").limit(limit)


def slack_messages(raw: DataFrame, now: datetime, users: DataFrame | None = None, permalinks: DataFrame | None = None) -> DataFrame:
    """Rows of the feed as messages.

    ``users`` (as USER) and ``permalinks`` (channel, ts, permalink) are joined
    where there are any; without one the columns are null. The reaction map
    keeps the last count of a name, the total adds up all of them.
    """
    text, blocks = F.coalesce("text", F.lit("")), P.blocks_text(F.col("blocks"))
    named = F.filter(F.coalesce("reactions", F.array().cast(SLACK_RAW["reactions"].dataType)), lambda r: F.coalesce(r["name"], F.lit("")) != "")
    last = F.aggregate(named, F.create_map().cast("map<string,int>"), lambda m, r: F.map_concat(F.map_filter(m, lambda k, _: k != r["name"]), F.create_map(r["name"], F.coalesce(r["count"], F.lit(0)))))
    n = X.lenient_number(F.col("ts"))
    bot = F.nullif(F.col("bot_id"), F.lit(""))
    rows = raw.withColumn("blocks_text", blocks).withColumn("combined", X.combine(text, F.col("blocks_text")))
    rows = rows.withColumn("links_raw", X.urls(F.col("combined")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    total = F.aggregate(named, F.lit(0), lambda a, r: a + F.coalesce(r["count"], F.lit(0)))
    out = rows.select(
        X.message_id(F.col("channel"), F.coalesce("ts", F.lit(""))).alias("message_id"), "channel", "ts", n.alias("ts_num"),
        F.when(F.coalesce("ts", F.lit("")) == "", F.lit(now).cast("timestamp")).otherwise(F.timestamp_micros(F.round(n * 1e6).cast("long"))).alias("ts_dt"),
        "user", F.col("user").alias("user_id"), "bot_id", (bot.isNotNull() | F.coalesce(F.col("subtype") == "bot_message", F.lit(False))).alias("is_bot"), "subtype", text.alias("text"), "blocks_text",
        X.normalize(F.col("combined")).alias("text_norm"), "links_raw", X.normalize_urls(F.col("links_raw")).alias("links_norm"), X.anchors(F.col("combined")).alias("anchors"),
        size("attachments").alias("attachments_count"), size("files").alias("files_count"), ((size("attachments") > 0) | (size("files") > 0)).alias("has_file"),
        last.alias("reactions"), total.alias("total_reactions"), total.alias("reactions_count"), F.coalesce("reply_count", F.lit(0)).alias("reply_count"),
        F.col("edited.ts").alias("edited_ts"), F.col("edited.user").alias("edited_user"), F.lit("slack").alias("source_id"), F.lit(now).cast("timestamp").alias("ingested_at"),
    )
    empty = raw.sparkSession.createDataFrame([], USER)
    known = (users if users is not None else empty).select(
        "user", _filled("real_name", "profile.real_name").alias("user_real_name"), _filled("profile.display_name", "name").alias("user_display_name"), F.col("profile.email").alias("user_email"),
        _filled("profile.image_512", "profile.image_192", "profile.image_72", "profile.image_48").alias("user_profile_image"),
    ).dropDuplicates(["user"])
    out = out.join(known, "user", "left")
    if permalinks is None:
        return out.withColumn("permalink", F.lit(None).cast("string"))
    return out.join(permalinks.dropDuplicates(["channel", "ts"]), ["channel", "ts"], "left")


def telegram_messages(raw: DataFrame, now: datetime) -> DataFrame:
    """Rows of the feed as messages: links of entities and of the text united in order of first sight, reactions of any shape as a map."""
    text = F.coalesce("text", F.lit(""))
    entities = F.coalesce("entities", F.array().cast(TELEGRAM_RAW["entities"].dataType))
    linked = F.filter(
        F.transform(entities, lambda e: F.when(e["kind"] == "url", F.substr(F.col("text"), e["offset"] + 1, e["length"])).when(e["kind"] == "text_link", e["url"])), lambda u: u.isNotNull()
    )
    reply = _filled("reply_to_message_id", "reply_to_msg_id")
    rows = raw.withColumn("links_raw", F.array_distinct(F.concat(linked, X.urls(text)))).withColumn("reactions_map", P.reactions(F.col("reactions")))
    rows = rows.withColumn("reply_to_id", X.message_id(F.col("channel"), reply))
    bot = F.coalesce("via_bot_id", "bot_id", "sender_bot_id")
    mime = _filled("file_mime", "mime_type", "mimeType")
    media = F.lower(F.coalesce("media_type", F.lit("")))
    count = lambda listed, n: F.coalesce(F.size(listed), F.col(n), F.lit(0))
    has_file = mime.isNotNull() | ~media.isin("", "text", "message") | (F.coalesce(F.size("files"), F.lit(0)) > 0) | F.coalesce("has_media", F.lit(False))
    return rows.select(
        X.message_id(F.col("channel"), F.coalesce("message_id", F.lit(""))).alias("message_id"), F.col("message_id").cast("long").alias("number"), "channel",
        F.coalesce("date", F.lit(now).cast("timestamp")).alias("ts_dt"), "sender_id", "sender_name", F.col("sender_id").alias("user_id"), bot.alias("bot_id"), (F.coalesce("is_bot", F.lit(False)) | bot.isNotNull()).alias("is_bot"),
        "reply_to_id", _filled("thread_id", "reply_to_id").alias("thread_id"), F.col("reply_to_id").isNotNull().alias("is_reply"), text.alias("text"), X.normalize(text).alias("text_norm"), text.alias("blocks_text"),
        "links_raw", X.normalize_urls(F.col("links_raw")).alias("links_norm"), X.anchors(text).alias("anchors"), F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("reply_count", F.lit(0)).alias("reply_count"),
        F.col("reactions_map").alias("reactions"), F.coalesce(F.aggregate(F.map_values("reactions_map"), F.lit(0), lambda a, n: a + n), F.lit(0)).alias("reactions_count"),
        F.coalesce(F.nullif(F.col("post_url"), F.lit("")), X.post_url(F.col("channel"), F.col("message_id"))).alias("post_url"), "forward_from_channel", "forward_from_message_id", "media_type",
        count("attachments", "attachments_count").alias("attachments_count"), count("files", "files_count").alias("files_count"), has_file.alias("has_file"), mime.alias("file_mime"),
        F.lit("telegram").alias("source_id"), F.lit(now).cast("timestamp").alias("ingested_at"),
    )


def new_numbers(messages: DataFrame, states: DataFrame, since: datetime | None = None) -> DataFrame:
    """Messages past their channel's last number and, without one, from ``since`` on."""
    mark = states.select("channel", F.col("last_processed_message_id").cast("long").alias("_last"))
    joined = messages.join(mark, "channel", "left")
    first = F.lit(True) if since is None else F.col("ts_dt") >= F.lit(since)
    return joined.where(F.when(F.col("_last").isNotNull(), F.col("number") > F.col("_last")).otherwise(first)).drop("_last")


def unified(slack: DataFrame, telegram: DataFrame) -> DataFrame:
    """Both feeds' messages as one table; what one feed lacks is null."""
    return slack.unionByName(telegram, allowMissingColumns=True)


READERS: dict[str, Callable[[DataFrame, datetime], DataFrame]] = {"slack": slack_messages, "telegram": telegram_messages}
SCHEMAS = {"slack": SLACK_RAW, "telegram": TELEGRAM_RAW}


def read_feed(spark: SparkSession, source: str, path: str, now: datetime) -> DataFrame:
    """Messages of a named feed's landing folder; lines that don't parse are no messages."""
    if source not in READERS:
        raise ValueError(f"unknown source {source!r}; known are {sorted(READERS)}")
    raw = read_landing(spark, path, SCHEMAS[source]).where("_corrupt_record is null").drop("_corrupt_record")
    if source == "slack":
        raw = roots(raw)
    return READERS[source](raw, now)


def pages(raw: DataFrame, size: int = 200) -> DataFrame:
    """Rows with the page of their channel that a cursor would name, oldest first."""
    w = Window.partitionBy("channel").orderBy(X.lenient_number(F.col("ts")), "ts")
    return raw.withColumn("page", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
