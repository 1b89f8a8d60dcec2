"""The digest: events of a window in order, as display blocks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import events as E
from skein.operators.criteria import in_window

CHUNK = 50


def digest_order() -> list:
    """Time, category, importance (highest first), id."""
    return [E.sort_time().asc(), E.category_order().asc(), F.col("importance").desc(), F.col("event_id").asc()]


def digest_events(events: DataFrame, start: datetime, end: datetime, min_confidence: float = 0.0, max_events: int | None = None) -> DataFrame:
    """Events of the window in the digest's order, limited, and only then without those that have critical issues."""
    some = in_window(events, start, end, min_confidence).orderBy(*digest_order())
    return (some if max_events is None else some.limit(max_events)).where(F.size(E.critical_issues()) == 0)


def blocks(chosen: DataFrame, header: str) -> DataFrame:
    """(pos, kind, text, chunk): a header and a divider, a section an event, a divider and the count; CHUNK blocks a message.

    A digest is what one message feed shows; its rows are ranked in one window.
    """
    spark = chosen.sparkSession
    ranked = chosen.select(F.row_number().over(Window.orderBy(*digest_order())).alias("pos"), E.digest_text().alias("text"))
    sections = ranked.select((F.col("pos") + 2).cast("long").alias("pos"), F.lit("section").alias("kind"), "text")
    n = chosen.agg(F.count("*").alias("n"))
    total = F.concat(F.lit("Total events: *"), F.col("n").cast("string"), F.lit("*"))
    foot = n.where("n > 0").select(F.explode(F.array(F.struct((F.col("n") + 3).alias("pos"), F.lit("divider").alias("kind"), F.lit("").alias("text")), F.struct((F.col("n") + 4).alias("pos"), F.lit("context").alias("kind"), total.alias("text")))).alias("x")).select("x.*")
    none = n.where("n = 0").select(F.lit(3).cast("long").alias("pos"), F.lit("section").alias("kind"), F.lit("_No new events._").alias("text"))
    head = spark.createDataFrame([(1, "header", header), (2, "divider", "")], "pos long, kind string, text string")
    every = head.unionByName(sections).unionByName(foot).unionByName(none)
    return every.withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK).cast("int"))


def header_text(at: datetime) -> str:
    return f"Events {at:%d.%m.%Y}"
