"""Features and score of a message under its channel's weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import text as X

# Caps and least counts of the score.
MAX_ANCHOR_SCORE, MAX_LINK_SCORE = 12.0, 6.0
MIN_REACTIONS, MIN_REPLIES = 2, 1


def occurrences(low: Column, keyword: Column) -> Column:
    """How often a lower-cased keyword stands in a lower-cased text, without overlap."""
    k = F.lower(keyword)
    return F.when(k == "", F.length(low) + 1).otherwise(((F.length(low) - F.length(F.replace(low, k, F.lit("")))) / F.length(k)).cast("int"))


def keyword_count(low: Column, keywords: Column) -> Column:
    return F.aggregate(F.coalesce(keywords, F.array().cast("array<string>")), F.lit(0), lambda n, k: n + occurrences(low, k))


def reaction_total(reactions: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(reactions), F.lit(0), lambda n, c: n + F.coalesce(c, F.lit(0))), F.lit(0))


def feed_features(channel_name: Column) -> Column:
    """Features of a message with blocks: keywords and mentions in the raw text and the blocks."""
    raw, blocks = F.coalesce("text", F.lit("")), F.coalesce("blocks_text", F.lit(""))
    low = F.lower(F.concat(raw, F.lit(" "), blocks))
    found = keyword_count(low, F.col("whitelist_keywords"))
    return F.struct(
        (found > 0).alias("has_keywords"), found.alias("keyword_count"),
        (X.mentions_channel(raw) | X.mentions_channel(blocks)).alias("has_mention"),
        F.coalesce("reply_count", F.lit(0)).cast("int").alias("reply_count"), reaction_total(F.col("reactions")).cast("int").alias("reaction_count"),
        F.size("anchors").alias("anchor_count"), F.size("links_norm").alias("link_count"), F.coalesce("has_file", F.lit(False)).alias("has_files"),
        F.coalesce("is_bot", F.lit(False)).alias("is_bot"), channel_name.alias("channel_name"), F.col("user_id").alias("author_id"), F.col("bot_id"),
    )


def plain_features(channel_name: Column) -> Column:
    """Features of a message of any other source: keywords and mentions in the normalised text, a reply counts as answered."""
    low = F.lower(F.coalesce("text_norm", F.lit("")))
    found = keyword_count(low, F.col("whitelist_keywords"))
    replies = F.coalesce("reply_count", F.lit(0)).cast("int")
    return F.struct(
        (found > 0).alias("has_keywords"), found.alias("keyword_count"), X.mentions_channel(F.col("text_norm")).alias("has_mention"),
        F.when(F.coalesce("is_reply", F.lit(False)), F.greatest(replies, F.lit(1))).otherwise(replies).alias("reply_count"),
        F.coalesce("reactions_count", F.lit(0)).cast("int").alias("reaction_count"),
        F.size("anchors").alias("anchor_count"), F.size("links_norm").alias("link_count"), F.coalesce("has_file", F.lit(False)).alias("has_files"),
        F.coalesce("is_bot", F.lit(False)).alias("is_bot"), channel_name.alias("channel_name"), F.lit("").alias("author_id"), F.col("bot_id"),
    )


def trusted(f: Column) -> Column:
    bots = F.coalesce("trusted_bots", F.array().cast("array<string>"))
    hit = lambda c: F.coalesce(F.array_contains(bots, F.nullif(c, F.lit(""))), F.lit(False))
    return hit(f["author_id"]) | hit(f["bot_id"])


def score(f: Column) -> Column:
    """The weighted sum of features ``f``; weights are columns of the channel."""
    add = lambda when, value: F.when(when, value).otherwise(F.lit(0.0))
    return (
        F.lit(0.0)
        + add(f["has_keywords"], F.col("keyword_weight") * f["keyword_count"])
        + add(f["has_mention"], F.col("mention_weight"))
        + add(f["reply_count"] >= MIN_REPLIES, F.col("reply_weight"))
        + add(f["reaction_count"] >= MIN_REACTIONS, F.col("reaction_weight"))
        + F.least(f["anchor_count"] * F.col("anchor_weight"), F.lit(MAX_ANCHOR_SCORE))
        + F.least(f["link_count"] * F.col("link_weight"), F.lit(MAX_LINK_SCORE))
        + add(f["has_files"], F.col("file_weight"))
        + add(f["is_bot"] & ~trusted(f), F.col("bot_penalty"))
    )


def explanations(f: Column) -> Column:
    parts = F.array(
        F.when(f["has_files"] & (F.col("file_weight") != 0), F.concat(F.lit("attachments weight +"), F.col("file_weight").cast("string"))),
        F.when(f["is_bot"] & trusted(f), F.lit("trusted bot bypass")),
        F.when(f["is_bot"] & ~trusted(f), F.lit("bot penalty applied")),
    )
    return F.filter(parts, lambda x: x.isNotNull())
