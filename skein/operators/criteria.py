"""Filters over events, candidates and messages, and ordered reads."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import events as E
from skein.functions import scoring


def every(conditions: list[Column]) -> Column:
    """True where all hold; with none, everywhere."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# Specifications: each is true or false, never null, so that they can be negated.


def known(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def all_of(*specs: Column) -> Column:
    return every([known(s) for s in specs])


def any_of(*specs: Column) -> Column:
    return reduce(lambda a, b: a | b, [known(s) for s in specs], F.lit(False))


def negated(spec: Column) -> Column:
    return ~known(spec)


def score_at_least(x: float) -> Column:
    return known(F.col("score") >= x)


def status_is(s: str) -> Column:
    return known(F.col("status") == s)


def has_links() -> Column:
    return known(F.size("links_norm") > 0)


def has_anchors() -> Column:
    return known(F.size("anchors") > 0)


def in_dates(start: datetime, end: datetime) -> Column:
    return known(E.sort_time().between(F.lit(start), F.lit(end)))


def recent(now: datetime, days: int) -> Column:
    return known(F.col("extracted_at") >= F.lit(now - timedelta(days=days)))


def category_is(c: str) -> Column:
    return known(F.col("category") == c)


def confidence_at_least(x: float) -> Column:
    return known(F.col("confidence") >= x)


def event_channel(c: str) -> Column:
    return known(F.array_contains("source_channels", c))


def is_bot() -> Column:
    return known(F.col("is_bot"))


def reactions_at_least(n: int) -> Column:
    return known(scoring.reaction_total(F.col("reactions")) >= n)


def message_channel(c: str) -> Column:
    return known(F.col("channel") == c)


def promising_candidate(least: float) -> Column:
    """New, scored high enough, with a link or an identifier."""
    return all_of(status_is("new"), score_at_least(least), any_of(has_links(), has_anchors()))


def recent_confident(now: datetime, days: int = 7, least: float = 0.7) -> Column:
    return all_of(recent(now, days), confidence_at_least(least))


def sure_product() -> Column:
    return all_of(category_is("product"), confidence_at_least(0.7))


def _ordered(df: DataFrame, order_by: str, desc: bool, limit: int | None, offset: int, tie: str) -> DataFrame:
    """Sorted, nulls last; an offset without a limit has no effect."""
    c = F.col(order_by)
    out = df.orderBy(c.desc_nulls_last() if desc else c.asc_nulls_last(), tie)
    return out if limit is None else out.offset(offset).limit(limit)


@dataclass(frozen=True)
class EventCriteria:
    """A query over events; what is None doesn't filter."""

    start: datetime | None = None
    end: datetime | None = None
    extracted_after: datetime | None = None
    extracted_before: datetime | None = None
    categories: tuple[str, ...] | None = None
    min_confidence: float | None = None
    max_confidence: float | None = None
    source_channels: tuple[str, ...] | None = None
    source_id: str | None = None
    message_ids: tuple[str, ...] | None = None
    limit: int | None = None
    offset: int = 0
    order_by: str = "extracted_at"
    order_desc: bool = True

    def condition(self) -> Column:
        c, out = F.col, []
        if self.start is not None:
            out.append(E.sort_time() >= F.lit(self.start))
        if self.end is not None:
            out.append(E.sort_time() <= F.lit(self.end))
        if self.extracted_after is not None:
            out.append(c("extracted_at") >= F.lit(self.extracted_after))
        if self.extracted_before is not None:
            out.append(c("extracted_at") <= F.lit(self.extracted_before))
        if self.categories:
            out.append(c("category").isin(*self.categories))
        if self.min_confidence is not None:
            out.append(c("confidence") >= self.min_confidence)
        if self.max_confidence is not None:
            out.append(c("confidence") <= self.max_confidence)
        if self.source_channels:
            out.append(known(F.arrays_overlap("source_channels", F.array(*map(F.lit, self.source_channels)))))
        if self.source_id is not None:
            out.append(c("source_id") == self.source_id)
        if self.message_ids:
            out.append(c("message_id").isin(*self.message_ids))
        return every(out)

    def apply(self, events: DataFrame) -> DataFrame:
        return _ordered(events.where(self.condition()), self.order_by, self.order_desc, self.limit, self.offset, "event_id")


@dataclass(frozen=True)
class CandidateCriteria:
    """A query over candidates; what is None doesn't filter."""

    min_score: float | None = None
    max_score: float | None = None
    status: str | None = None
    channel: str | None = None
    after: datetime | None = None
    before: datetime | None = None
    has_links: bool | None = None
    has_anchors: bool | None = None
    limit: int | None = None
    offset: int = 0
    order_by: str = "score"
    order_desc: bool = True

    def condition(self) -> Column:
        c, out = F.col, []
        for value, make in (
            (self.min_score, lambda v: c("score") >= v), (self.max_score, lambda v: c("score") <= v), (self.status, lambda v: c("status") == v),
            (self.channel, lambda v: c("channel") == v), (self.after, lambda v: c("ts_dt") >= F.lit(v)), (self.before, lambda v: c("ts_dt") <= F.lit(v)),
        ):
            if value is not None:
                out.append(make(value))
        for value, spec in ((self.has_links, has_links()), (self.has_anchors, has_anchors())):
            if value is not None:
                out.append(spec if value else ~spec)
        return every(out)

    def apply(self, candidates: DataFrame) -> DataFrame:
        return _ordered(candidates.where(self.condition()), self.order_by, self.order_desc, self.limit, self.offset, "message_id")


def recent_events(now: datetime, days: int = 7) -> EventCriteria:
    return EventCriteria(extracted_after=now - timedelta(days=days))


def high_priority(threshold: float = 15.0) -> CandidateCriteria:
    return CandidateCriteria(status="new", min_score=threshold)


def product_events(start: datetime, end: datetime) -> EventCriteria:
    return EventCriteria(start=start, end=end, categories=("product",), min_confidence=0.7, order_by="actual_start", order_desc=False)


def in_window(events: DataFrame, start: datetime, end: datetime, min_confidence: float = 0.0, max_events: int | None = None, desc: bool = False) -> DataFrame:
    """Events whose own time lies in the window, both ends included; those without a time are never in it."""
    t = E.event_time()
    kept = events.where(t.between(F.lit(start), F.lit(end)) & (F.col("confidence") >= min_confidence))
    out = kept.orderBy(t.desc() if desc else t.asc(), "event_id")
    return out if max_events is None else out.limit(max_events)


def newest(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows by ``order``; none for a limit below one."""
    return df.orderBy(*order).limit(max(limit, 0))


def recent_messages(messages: DataFrame, limit: int = 100) -> DataFrame:
    return newest(messages, [F.col("ts_dt").desc(), F.col("message_id")], limit)


def recent_candidates(candidates: DataFrame, limit: int = 100) -> DataFrame:
    return newest(candidates, [F.col("score").desc(), F.col("ts_dt").desc(), F.col("message_id")], limit)


def last_extracted(events: DataFrame, limit: int = 100) -> DataFrame:
    return newest(events, [F.col("extracted_at").desc(), F.col("event_id")], limit)


def channel_messages(messages: DataFrame, channel: str | None = None, limit: int = 100) -> DataFrame:
    kept = messages if channel is None else messages.where(F.col("channel") == channel)
    return recent_messages(kept, limit)


def candidates_by_source(candidates: DataFrame, source: str, limit: int = 100) -> DataFrame:
    return recent_candidates(candidates.where(F.col("source_id") == source), limit)


def events_by_source(events: DataFrame, source: str, limit: int = 100) -> DataFrame:
    return last_extracted(events.where(F.col("source_id") == source), limit)


def events_by_cluster(events: DataFrame, key: str) -> DataFrame:
    return events.where(F.col("cluster_key") == key).orderBy("extracted_at", "event_id")


def related_events(events: DataFrame, relations: DataFrame, event_id: object) -> DataFrame:
    """Events that ``event_id`` has a relation to."""
    targets = relations.where(F.col("source_event_id") == event_id).select(F.col("target_event_id").alias("event_id"), "relation_type")
    return targets.join(events, "event_id")
