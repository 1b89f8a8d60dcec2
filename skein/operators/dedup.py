"""Merging of events that report the same thing.

The rule is order-dependent: events are taken by time, and each merges into the
first earlier one that matches. Only events that share an identifier, a link, a
cluster key or a dedup key can affect each other, so the rule is applied to the
connected components of that relation, one component a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import events as E
from skein.functions.python import ratio, similarity
from skein.operators import graph
from skein.plans.store import staged

WINDOW_HOURS, SIMILARITY = 48, 0.8
#: Windows without an event after which what shares an identifier is no longer tied.
GAP = 5
#: Windows in a slot in which events with a time meet.
SPAN = 4

_A = T.ArrayType(T.StringType())
#: The columns of an event; others are dropped.
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("event_id", T.StringType()), ("message_id", T.StringType()), ("source_channels", _A), ("extracted_at", T.TimestampType()), ("source_id", T.StringType()),
        ("action", T.StringType()), ("object_id", T.StringType()), ("object_name_raw", T.StringType()), ("qualifiers", _A), ("stroke", T.StringType()), ("anchor", T.StringType()),
        ("category", T.StringType()), ("status", T.StringType()), ("change_type", T.StringType()), ("environment", T.StringType()), ("severity", T.StringType()),
        ("planned_start", T.TimestampType()), ("planned_end", T.TimestampType()), ("actual_start", T.TimestampType()), ("actual_end", T.TimestampType()),
        ("time_source", T.StringType()), ("time_confidence", T.DoubleType()), ("summary", T.StringType()), ("why_it_matters", T.StringType()),
        ("links", _A), ("anchors", _A), ("impact_area", _A), ("impact_type", _A), ("confidence", T.DoubleType()), ("importance", T.IntegerType()),
        ("cluster_key", T.StringType()), ("dedup_key", T.StringType()),
    )]
)
_ARRAYS = [f.name for f in SCHEMA if isinstance(f.dataType, T.ArrayType)]
_TIMES = ("actual_start", "actual_end", "planned_start", "planned_end")
#: The columns that the rule reads.
RULE = {"event_id", "message_id", "extracted_at", "source_id", "action", "object_id", "object_name_raw", "qualifiers", "stroke", "anchor", "status", "environment", "links", "anchors", "dedup_key", *_TIMES}
_HEX = ("event_id", "message_id", "cluster_key", "dedup_key")


def _rows(events: DataFrame) -> DataFrame:
    """A row for each identifier or link of an event: ids, time, and hashes of its source with the key and of its title."""
    shared = F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("anchors", "links")]))
    some = events.select("event_id", "message_id", "source_id", F.unix_micros(E.event_time().cast("timestamp")).alias("t"), F.xxhash64(E.title()).alias("title"), F.explode(shared).alias("key"))
    key = F.unhex(F.md5(F.concat("source_id", F.lit("\0"), "key")))
    return some.where("source_id is not null and key is not null").select(key.alias("key"), "event_id", "message_id", "t", "title")


def _marked(rows: DataFrame, mark: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{mark}_{c}") for c in rows.columns])


def _titles(*events: DataFrame) -> DataFrame:
    """(h, title) of all titles by their hash; two titles of one hash, which 64 bits make next to impossible, are an error."""
    every = reduce(DataFrame.unionByName, [e.select(E.title().alias("title")).where("title is not null") for e in events])
    by = every.groupBy(F.xxhash64("title").alias("h")).agg(F.min("title").alias("title"), F.max("title").alias("last"))
    same = F.when(F.col("title") == F.col("last"), F.col("title")).otherwise(F.raise_error(F.lit("two titles have one hash")).cast("string"))
    return by.select("h", same.alias("title"))


def _alike(met: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """Each pair (left_id, right_id, a, b) of ``met``, a and b being hashes of titles, once, with the similarity of the titles, if that is ``least`` or more.

    Each pair of titles is compared once, however many events bear them. What
    grows with the events is joined by a shuffle: it is several times larger
    than its estimate, by which Spark would broadcast it.
    """
    once = met.dropDuplicates(["left_id", "right_id"])
    pairs = once.select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(titles.select(F.col("h").alias(side), F.col("title").alias(f"{side}_title")).hint("merge"), side)
    scored = pairs.withColumn("similarity", similarity(F.col("a_title"), F.col("b_title"))).where(F.col("similarity") >= least)
    return once.join(scored.select("a", "b", "similarity").hint("merge"), ["a", "b"]).select("left_id", "right_id", "similarity")


def _slot(t: str, micros: int) -> Column:
    return F.floor(F.col(t) / micros).cast("int")


def matching_pairs(events: DataFrame, hours: int = WINDOW_HOURS, least: float = SIMILARITY) -> DataFrame:
    """(left_id, right_id, similarity): pairs that the rule would merge, left before right by id.

    Rows with a time meet in slots of SPAN windows. Each lies in its own, and in
    the next too if a window reaches it, so both of a pair are in the slot of
    the later one. Both sides are one shuffled table.
    """
    micros, rows = hours * 3_600_000_000, _rows(events)
    span = SPAN * micros
    timed = rows.where("t is not null").withColumn("slot", F.explode(F.array_distinct(F.array(_slot("t", span), F.floor((F.col("t") + micros) / span).cast("int")))))
    dealt = timed.withColumn("copy", (F.col("slot") != _slot("t", span)).cast("int"))
    same = (F.col("l_key") == F.col("r_key")) & (F.col("l_message_id") != F.col("r_message_id"))
    ahead = (F.col("l_event_id") < F.col("r_event_id")) & (F.col("l_copy") + F.col("r_copy") < 2)
    near = _marked(dealt, "l").join(_marked(dealt, "r").hint("merge"), same & (F.col("l_slot") == F.col("r_slot")) & ahead & (F.abs(F.col("l_t") - F.col("r_t")) <= micros))
    near = near.select(F.col("l_event_id").alias("left_id"), F.col("r_event_id").alias("right_id"), F.col("l_title").alias("a"), F.col("r_title").alias("b"))
    # an event without a time meets all that share a key; the pair is turned round where its id is the larger
    any_ = _marked(rows.where("t is null").drop("t"), "l").join(_marked(rows.drop("t"), "r").hint("merge"), same & (F.col("l_event_id") != F.col("r_event_id")))
    first = F.col("l_event_id") < F.col("r_event_id")
    turn = lambda c, d: F.when(first, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")) if d == "l" else F.when(first, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}"))
    far = any_.select(turn("event_id", "l").alias("left_id"), turn("event_id", "r").alias("right_id"), turn("title", "l").alias("a"), turn("title", "r").alias("b"))
    return _alike(near.unionByName(far), _titles(events), least)


def matching_stored(new: DataFrame, stored: DataFrame, hours: int = WINDOW_HOURS, least: float = SIMILARITY) -> DataFrame:
    """(new_id, stored_id, similarity): all stored events that each new one matches.

    New rows with a time meet stored ones in slots of a window, their own and both beside it.
    """
    micros, left, right = hours * 3_600_000_000, _marked(_rows(new), "l"), _marked(_rows(stored), "r")
    same = (F.col("l_key") == F.col("r_key")) & (F.col("l_event_id") != F.col("r_event_id")) & (F.col("l_message_id") != F.col("r_message_id"))
    around = left.where("l_t is not null").withColumn("l_slot", F.explode(F.array(*[_slot("l_t", micros) + i for i in (-1, 0, 1)])))
    timed = right.where("r_t is not null").withColumn("r_slot", _slot("r_t", micros))
    near = around.join(timed.hint("merge"), same & (F.col("l_slot") == F.col("r_slot")) & (F.abs(F.col("l_t") - F.col("r_t")) <= micros)).drop("l_slot", "r_slot")
    met = near.unionByName(left.where("l_t is null").join(right.hint("merge"), same)).unionByName(left.where("l_t is not null").join(right.where("r_t is null").hint("merge"), same))
    pairs = met.select(F.col("l_event_id").alias("left_id"), F.col("r_event_id").alias("right_id"), F.col("l_title").alias("a"), F.col("r_title").alias("b"))
    return _alike(pairs, _titles(new, stored), least).withColumnsRenamed({"left_id": "new_id", "right_id": "stored_id"})


def _tokens(events: DataFrame, hours: int, keys: bool) -> DataFrame:
    """(event, token, low, high): hashes of an event and of what ties it to others, and the first and last slot of its times.

    Ids of 64 bits do, since two that are equal by chance only tie events that
    aren't, which the rule leaves apart. A cluster key holds its event's first
    anchor, so it ties nothing that the anchor doesn't, unless that is empty or
    holds the separator. A dedup key made of an event's own values ties nothing
    that its cluster key doesn't; ``keys`` says that some are others.
    """
    none = F.array().cast("array<string>")
    of = lambda mark, c: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit(mark), x))
    first = F.coalesce(F.get("anchors", F.lit(0)), F.lit(""))
    parts = F.concat_ws("", "action", "object_id", "object_name_raw", first)
    cluster = F.when((first == "") | F.contains(parts, F.lit("|")), F.concat(F.lit("c:"), E.cluster_key()))
    own = [cluster, F.concat(F.lit("d:"), F.col("dedup_key"))] if keys else [cluster]
    every = F.filter(F.concat(of("s:", F.col("anchors")), of("s:", F.col("links")), F.array(*own)), lambda x: x.isNotNull())
    slot = lambda t: F.floor(F.unix_micros(t) / (hours * 3_600_000_000)).cast("int")
    edges = F.transform(F.filter(F.array(*_TIMES), lambda t: t.isNotNull()), slot)
    token = F.explode(F.array_distinct(F.transform(every, lambda x: F.xxhash64(x))))
    return events.select(F.xxhash64("event_id").alias("event"), F.array_min(edges).alias("low"), F.array_max(edges).alias("high"), token.alias("token"))


def _labels(events: DataFrame, hours: int) -> DataFrame:
    """(event, label): equal labels for the events, by hash of their id, that tokens tie together; those that nothing ties are left out.

    A token is cut where no event that has it has any time for GAP windows of
    ``hours``. Merging can move an event's time on, if it adds a time of a kind
    that goes first; there are four kinds, so three steps of a window at most,
    and one more reaches the next event. So nothing before such a gap can
    match anything after it. A token with an event without a time isn't cut,
    since that matches at any time.

    A token's slots are few however popular it is, so its rows are grouped by
    them before they meet, and each gets the smallest event of its part. Events
    whose tokens agree on that are labelled; only where they differ are parts
    tied to each other.
    """
    keys = bool(events.where(~F.col("dedup_key").eqNullSafe(E.dedup_key())).limit(1).count())
    rows = _tokens(events, hours, keys)
    group = F.xxhash64("token", "low", "high")
    slots = rows.groupBy("token", "low", "high").agg(F.min("event").alias("least"), F.max("event").alias("most"))
    token = Window.partitionBy("token")
    before = token.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    upto = token.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    open_ = F.max(F.col("low").isNull()).over(token)
    gap = F.coalesce((F.col("low") - F.max("high").over(before) > GAP).cast("int"), F.lit(0))
    cut = slots.withColumn("open", open_).withColumn("gap", F.when(F.col("open"), 0).otherwise(gap)).withColumn("part", F.sum("gap").over(upto))
    whole = Window.partitionBy("token", "part")
    part = cut.withColumn("root", F.min("least").over(whole)).withColumn("last", F.max("most").over(whole)).where("root <> last").select(group.alias("g"), "root")
    roots = rows.select(group.alias("g"), "event").join(part.hint("merge"), "g").groupBy("event").agg(F.min("root").alias("root"), F.collect_set("root").alias("all"))
    tied = staged(roots.select("event", "root", F.when(F.size("all") > 1, F.col("all")).alias("all")), "ties")
    found = graph.components(tied.where("all is not null").select(F.explode("all").alias("a"), F.col("root").alias("b")))
    to = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
    return tied.select("event", "root").join(to.hint("merge"), "root", "left").select("event", F.coalesce("to", "root").alias("label"))


def components(events: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    """(event_id, component): the smallest id reachable over shared tokens."""
    at = F.xxhash64("event_id").alias("event")
    labelled = events.select("event_id", at).join(_labels(events, hours).hint("merge"), "event", "left").select("event_id", F.coalesce("label", "event").alias("label"))
    first = labelled.groupBy("label").agg(F.min("event_id").alias("component"))
    return labelled.join(first.hint("merge"), "label").select("event_id", "component")


def _time(e: dict[str, Any]) -> datetime | None:
    return next((e[c] for c in _TIMES if e[c] is not None), None)


def _title(e: dict[str, Any]) -> str:
    """The canonical title of one event, as ``events.title`` gives it."""
    name, action = e["object_name_raw"] or "", e["action"]
    head = f"{action}: {name}"
    quoted = lambda n: " — " + ", ".join(e["qualifiers"][:n]) if e["qualifiers"] else ""
    stroke = f", {e['stroke']}" if e["stroke"] else ""
    anchor = f" ({e['anchor']})" if e["anchor"] else ""
    for t in (head + quoted(2) + stroke + anchor, head + quoted(2) + anchor, head + quoted(1) + anchor, head + quoted(1), head):
        if len(t) <= E.MAX_TITLE:
            return t
    return f"{action}: {name[: max(E.MAX_TITLE - 4 - len(action), 0)]}..."


def _key(e: dict[str, Any]) -> str:
    name = e["object_id"] or (e["object_name_raw"] or "").lower().strip()
    first = e["anchors"][0] if e["anchors"] else ""
    cluster = hashlib.sha1(f"{e['action']}||{name}||{first}".encode()).hexdigest()
    at = _time(e)
    text = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat() if at else "no-time"
    return hashlib.sha1(f"{cluster}||{e['status']}||{text}||{e['environment']}".encode()).hexdigest()


def _matches(a: dict[str, Any], b: dict[str, Any], hours: int, least: float) -> bool:
    if a["message_id"] == b["message_id"] or a["source_id"] != b["source_id"]:
        return False
    if set(a["anchors"]).union(a["links"]).isdisjoint([*b["anchors"], *b["links"]]):
        return False
    s, t = _time(a), _time(b)
    if s and t and abs((s - t).total_seconds()) > hours * 3600:
        return False
    return ratio(_title(a), _title(b)) >= least


def _merged(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    """``a`` with what ``b`` adds; lists are united in the order of first sight."""
    out = dict(a)
    for c, most in (("links", 3), ("source_channels", None), ("anchors", None), ("impact_area", 3), ("impact_type", None), ("qualifiers", 2)):
        if c in a:
            out[c] = list(dict.fromkeys(a[c] + b[c]))[:most]
    for c in ("confidence", "importance", "time_confidence"):
        if c in a:
            out[c] = max((x for x in (a[c], b[c]) if x is not None), default=None)
    for c in _TIMES:
        out[c] = min((x for x in (a[c], b[c]) if x is not None), default=None)
    for c in ("stroke", "anchor", "severity", "why_it_matters"):
        if c in a:
            out[c] = a[c] or b[c]
    out["dedup_key"] = _key(out)
    return out


def fold(events: list[dict[str, Any]], hours: int = WINDOW_HOURS, least: float = SIMILARITY) -> list[dict[str, Any]]:
    """The rule on events in order: skip a known key, merge into the first match (which moves to the end), else append.

    Places are looked up by shared identifier or link, so an event is compared
    only with those that it could match.
    """
    kept: dict[int, dict[str, Any]] = {}
    at: dict[str, set[int]] = {}
    keys: set[str] = set()
    place = 0

    def put(e: dict[str, Any]) -> None:
        nonlocal place
        kept[place] = e
        for k in {*e["anchors"], *e["links"]}:
            at.setdefault(k, set()).add(place)
        keys.add(e["dedup_key"])
        place += 1

    for e in events:
        if e["dedup_key"] in keys:
            continue
        near = sorted(set().union(*(at.get(k, ()) for k in {*e["anchors"], *e["links"]})))
        hit = next((p for p in near if _matches(e, kept[p], hours, least)), None)
        if hit is None:
            put(e)
            continue
        target = kept.pop(hit)
        for k in {*target["anchors"], *target["links"]}:
            at[k].discard(hit)
        keys.discard(target["dedup_key"])
        put(_merged(target, e))
    return list(kept.values())


def _bytes_of(c: str) -> Column:
    """A string of lower-case hexadecimal digits as its bytes, half as many; null for any other."""
    return F.when(F.rlike(F.col(c), F.lit("^([0-9a-f]{2})+$")), F.unhex(c))


def deduplicate(events: DataFrame, hours: int = WINDOW_HOURS, least: float = SIMILARITY, columns: Sequence[str] | None = None) -> DataFrame:
    """The events after the rule, with SCHEMA's columns, or those of ``columns``.

    Events of a component are sorted by time, time of extraction and id. Null
    arrays count as empty. A component is one task's group. It ends where an
    identifier isn't seen for longer than ``hours``; one that ties very many
    events together without such a gap makes a large group, which
    ``component_sizes`` reports. Columns that neither the rule nor ``columns``
    names aren't moved, and digests are moved as bytes.
    """
    schema = T.StructType([f for f in SCHEMA if columns is None or f.name in columns])
    fields = [f for f in SCHEMA if f.name in RULE or f in schema.fields]
    base = events.select(*[(F.coalesce(f.name, F.array().cast("array<string>")) if f.name in _ARRAYS else F.col(f.name)).cast(f.dataType).alias(f.name) for f in fields])
    base = staged(base, "events")
    hexed = [c for c in _HEX if c in base.columns]
    packed = [F.when(_bytes_of(c).isNull(), F.col(c)).alias(c) if c in hexed else F.col(c) for c in base.columns] + [_bytes_of(c).alias(f"{c}_bytes") for c in hexed]
    at = F.xxhash64("event_id")
    labelled = base.select(at.alias("event"), *packed).join(_labels(base, hours).hint("merge"), "event", "left").withColumn("event", F.coalesce("label", "event")).drop("label")
    id_ = F.coalesce("event_id", F.lower(F.hex("event_id_bytes")))
    dealt = labelled.repartition("event").sortWithinPartitions("event", E.sort_time(), "extracted_at", id_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        now, held = None, []

        def folded() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(fold(held, hours, least), made)

        for batch in batches:
            if made is None:
                kinds = {f.name: f.type for f in batch.schema}
                made = pa.schema([(f.name, kinds[f.name]) for f in schema])
            for row in batch.to_pylist():
                c = row.pop("event")
                for k in hexed:
                    if (x := row.pop(f"{k}_bytes")) is not None:
                        row[k] = x.hex()
                if c != now and held:
                    yield folded()
                    held = []
                now = c
                held.append(row)
        if held:
            yield folded()

    return dealt.mapInArrow(run, schema)


def component_sizes(events: DataFrame) -> DataFrame:
    return components(events).groupBy("component").agg(F.count("*").alias("n"))


def dedup_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(total_events, merged_events, new_events)."""
    a, b = before.agg(F.count("*").alias("total_events")), after.agg(F.count("*").alias("new_events"))
    return a.join(F.broadcast(b), F.lit(True)).select("total_events", (F.col("total_events") - F.col("new_events")).alias("merged_events"), "new_events")  # one row each
