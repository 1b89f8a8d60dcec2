"""URL filters as of the time of fetching, with DataFrame functions only.

A list changes over time: dated entries add and remove keys. Between two
changes a key's state is a validity interval. A capture is joined as of its
date with the intervals of all keys that cover its URL; the longest key
decides, and of equal ones a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a slot.
SLOT = 30


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; empty if there is none."""
    rest = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, without a final slash."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(rest, r"/+$", "")


def covering_keys(host: Column, path: Column) -> Column:
    """All keys that cover a URL: the host and the domains above it, the host with each leading part of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/")
    paths = F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/")))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, list_name, verdict, valid_from, valid_to) of ``entries`` (key, list_name, verdict, action, dated).

    ``action`` is add or remove. Of several entries of one key and list on one
    date a removal wins, and of adds the smaller verdict. A key's state lasts
    to its list's next entry for it; valid_to is exclusive and null while it
    lasts. The host in a key is lower-cased. Entries with a null in any column are left out.
    """
    day = (
        entries.select(F.concat(F.lower(F.substring_index("key", "/", 1)), F.expr("substr(key, length(substring_index(key, '/', 1)) + 1)")).alias("key"), "list_name", "verdict", "action", "dated").dropna()
        .groupBy("key", "list_name", "dated")
        .agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed"), F.min("verdict").alias("verdict"))
    )
    later = Window.partitionBy("key", "list_name").orderBy("dated")
    return day.withColumn("valid_to", F.lead("dated").over(later)).where("removed = 0").select("key", "list_name", "verdict", F.col("dated").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", date_col: str = "fetched_on", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each capture: ``carry``, url_col, date_col, verdict, matched_key, list_name, valid_from.

    verdict is that of the longest covering key that is listed on the capture's
    date; of equal keys block precedes allow, then the smaller list name, then
    the earlier interval. Without one, or without a date or a host, it is
    ``none`` and the other three are null. Repeated captures are rows of their
    own; an empty table gives an empty one. URLs of any length are read whole. The join is by key and by slots of
    the calendar, so a popular key's captures and intervals are spread over the
    slots; an interval is listed under those slots only in which captures lie.
    """
    day = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / SLOT).cast("int")
    rows = captures.select(F.monotonically_increasing_id().alias("row"), *carry, F.col(url_col), F.col(date_col)).withColumn("slot", day(F.col(date_col)))
    keyed = rows.select("row", *carry, url_col, date_col, "slot", F.explode_outer(covering_keys(host_of(F.col(url_col)), path_of(F.col(url_col)))).alias("key"))
    # the slots that captures lie in: a date has at most 121,747 of them, the years 1 to 9999
    used = sorted(r.slot for r in captures.select(day(F.col(date_col)).alias("slot")).where("slot is not null").distinct().collect())
    listed = intervals(entries).where(F.lit(bool(used)))
    until = F.coalesce(day(F.date_sub("valid_to", 1)), F.lit(used[-1] if used else 0))
    slots = F.filter(F.lit(used or [0]).cast("array<int>"), lambda s: (s >= F.col("since")) & (s <= F.col("until")))
    spread = listed.withColumn("since", day(F.col("valid_from"))).withColumn("until", until).select(F.col("key").alias("k"), "list_name", "verdict", "valid_from", "valid_to", F.explode(slots).alias("s"))
    active = (F.col("key") == F.col("k")) & (F.col("slot") == F.col("s")) & (F.col("valid_from") <= F.col(date_col)) & (F.col("valid_to").isNull() | (F.col(date_col) < F.col("valid_to")))
    met = keyed.join(spread, active, "left")
    rank = F.struct(
        (-F.length("k")).alias("length"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("order"),
        F.col("list_name"), F.col("valid_from"), F.col("k").alias("matched_key"), F.col("verdict"),
    )
    first = met.groupBy("row").agg(F.min(F.struct(*carry, url_col, date_col)).alias("c"), F.min(F.when(F.col("k").isNotNull(), rank)).alias("m"))
    return first.select("c.*", F.coalesce("m.verdict", F.lit("none")).alias("verdict"), "m.matched_key", "m.list_name", "m.valid_from")
