"""The registered queries over the derived views, each with its SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import events as E
from skein.functions import python as P
from skein.functions import text as X
from skein.operators import candidates as C
from skein.operators import criteria as Q
from skein.operators import dedup, digest, extract, objects
from skein.operators import state as S
from skein.plans import fixtures as V
from skein.plans import sql as L
from skein.plans.store import scratch, staged
from skein.sources import feeds
from skein.streaming import feeds as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 20, 12)
START, END = datetime(1995, 1, 1), datetime(1997, 12, 31)
REGISTRY = {"wallet.stocks": ["Stocks & ETFs", "Stock trading", "object 1"], "data.clickhouse": ["CH cluster", "ClickHouse", "object 17"], "pay.core": ["Payments core", "object 22", "object 2"]}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.normalized(V.messages(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored messages. Texts are cleaned once and written, as ingest does it: scores read the clean text several times."""
    return C.score_messages(staged(messages(spark, sf_dir), "messages"), V.channels(spark))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all states, as a written table, which they are in a run."""
    s = staged(scored(spark, sf_dir), "scored").where(F.col("score") >= F.col("threshold_score"))
    status = F.when(F.col("event_id") % 5 == 0, "processing").when(F.col("event_id") % 5 == 1, "llm_ok").otherwise("new")
    start = F.when(F.col("event_id") % 10 == 0, F.col("ts_dt"))
    return s.withColumn("status", status).withColumn("processing_started_at", start).withColumn("lease_attempts", F.lit(0))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).withColumn("cluster_key", E.cluster_key()).withColumn("dedup_key", E.dedup_key())


# Text


@query(f"WITH {L.M}, {L.N} SELECT message_id, text_norm FROM n")
def text_normalize(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", "text_norm")


@query(f"WITH {L.M}, {L.N} SELECT message_id, array_to_string(links_raw, '|') AS links_raw, array_to_string(links_norm, '|') AS links_norm FROM n")
def links(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", joined("links_raw").alias("links_raw"), joined("links_norm").alias("links_norm"))


@query(f"WITH {L.M}, {L.N} SELECT message_id, array_to_string(anchors, '|') AS anchors FROM n")
def anchors(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", joined(F.array_sort("anchors")).alias("anchors"))


@query(f"SELECT page_id, {L.url('url')} AS url_norm FROM pages")
def url_normalize(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url_norm"))


@query(
    "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 3.0)) END AS INTEGER) AS nano, "
    "CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0)) END AS INTEGER) AS other, 3500 AS budget FROM documents"
)
def token_estimates(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    est = lambda m: X.token_estimate(F.col("text"), F.lit(m))
    return d.select("doc_id", est("gpt-5-nano").alias("nano"), est("some-model").alias("other"), X.prompt_budget(F.lit("gpt-5-nano")).alias("budget"))


@query()
def chunks(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(P.text_chunks(F.col("text"), F.lit(1500))).alias("pos", "chunk"))
    return d.select("doc_id", "pos", "chunk")


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS preview, substr(text, 11, 5) AS part FROM documents")
def previews(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", X.preview(F.col("text"), 60).alias("preview"), X.span(F.col("text"), F.lit(10), F.lit(5)).alias("part"))


@query("SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Amsterdam', '%d.%m.%Y %H:%M') AS local FROM events")
def local_times(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", X.local_time(F.col("ts"), "Europe/Amsterdam").alias("local"))


_RAW_TIME = "CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'soon' WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END"


@query(f"SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 3) THEN CASE WHEN event_id % 5 = 1 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END END AS at FROM (SELECT *, {_RAW_TIME} AS raw FROM events)")
def parsed_times(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.col("event_id") % 5
    raw = F.when(m == 0, F.concat(iso, F.lit("Z"))).when(m == 1, F.date_format("ts", "yyyy-MM-dd")).when(m == 2, "soon").when(m == 3, iso)
    return e.select("event_id", X.parse_time(raw).cast("timestamp_ntz").alias("at"))


@query(f"WITH {L.M}, {L.N} SELECT message_id, 'Channel: #' || channel || chr(10) || 'Message timestamp: ' || strftime(ts_dt, '%Y-%m-%d %H:%M') || ' UTC' || chr(10) || chr(10) || 'Message text:' || chr(10) || text_norm "
       "|| CASE WHEN len(links_norm) > 0 THEN chr(10) || chr(10) || 'Relevant links:' || chr(10) || array_to_string(list_transform(links_norm[1:3], lambda u: '- ' || u), chr(10)) ELSE '' END AS prompt FROM n")
def prompts(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", X.prompt(F.col("text_norm"), F.col("links_norm"), F.col("ts_dt"), F.col("channel")).alias("prompt"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN user_id / 1e6 * 0.15 + 100 / 1e6 * 0.6 ELSE user_id / 1e6 * 0.075 + 100 / 1e6 * 0.3 END AS cost FROM events")
def call_costs(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", E.cost(F.col("user_id"), F.lit(100), F.when(F.col("event_type") == "click", "gpt-4o-mini").otherwise("unheard-of")).alias("cost"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS lang FROM documents")
def enum_fallback(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", E.one_of(F.col("lang"), ("en", "de"), "other").alias("lang"))


# Scoring


@query(L.SCORED + " SELECT message_id, keyword_count > 0 AS has_keywords, CAST(keyword_count AS INTEGER) AS keyword_count, has_mention, replies AS reply_count, reaction_count, "
       "CAST(anchor_count AS INTEGER) AS anchor_count, CAST(link_count AS INTEGER) AS link_count, has_file AS has_files, is_bot, channel_name FROM s")
def message_features(spark, sf_dir):
    f = ["has_keywords", "keyword_count", "has_mention", "reply_count", "reaction_count", "anchor_count", "link_count", "has_files", "is_bot", "channel_name"]
    return scored(spark, sf_dir).select("message_id", *[F.col(f"features.{c}").alias(c) for c in f])


@query(L.SCORED + " SELECT message_id, score, array_to_string(list_filter([CASE WHEN has_file AND file_weight <> 0 THEN 'attachments weight +' || file_weight END, "
       "CASE WHEN is_bot THEN CASE WHEN bot_id = 'B1' AND bot_id IS NOT NULL THEN 'trusted bot bypass' ELSE 'bot penalty applied' END END], lambda x: x IS NOT NULL), '|') AS why FROM s")
def message_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("message_id", "score", joined("explanations").alias("why"))


@query(L.SCORED + " SELECT message_id, channel, source_id, score FROM s WHERE score >= threshold_score")
def new_candidates(spark, sf_dir):
    return C.select_candidates(scored(spark, sf_dir)).select("message_id", "channel", "source_id", "score")


@query(L.SCORED + " SELECT (SELECT count(*) FROM n) AS messages_processed, count(*) AS scored, count_if(score >= threshold_score) AS candidates_created, "
       "round(coalesce(avg(score), 0), 6) AS average_score, coalesce(max(score), 0.0) AS max_score, coalesce(min(score), 0.0) AS min_score FROM s")
def candidate_stats(spark, sf_dir):
    return C.candidate_stats(messages(spark, sf_dir), scored(spark, sf_dir)).withColumn("average_score", F.round("average_score", 6))


@query(L.SCORED + " SELECT message_id, channel, score FROM k ORDER BY score DESC, ts_dt DESC, message_id LIMIT 20")
def top_candidates(spark, sf_dir):
    return Q.recent_candidates(candidates(spark, sf_dir), 20).select("message_id", "channel", "score")


@query(L.SCORED + " SELECT message_id FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.message_id = n.message_id) AND source_id = 'slack'")
def unprocessed_messages(spark, sf_dir):
    return C.unprocessed(messages(spark, sf_dir), candidates(spark, sf_dir), "slack").select("message_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").join(V.table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query(L.SCORED + ", t AS (SELECT score, row_number() OVER (ORDER BY score DESC, message_id) - 1 AS i, least(1000, count(*) OVER ()) AS n FROM k WHERE status = 'new') "
       "SELECT max(score) AS min_score FROM t WHERE n >= 10 AND i = floor(n * 0.1)")
def score_cut(spark, sf_dir):
    return C.score_cut(candidates(spark, sf_dir))


@query(L.SCORED + ", d AS (SELECT *, CASE WHEN status = 'processing' AND (event_id % 10 <> 0 OR ts_dt < TIMESTAMP '2024-01-20 11:45:00') THEN 'new' ELSE status END AS now_status FROM k), "
       "r AS (SELECT message_id, row_number() OVER (ORDER BY score DESC, message_id) AS i FROM d WHERE now_status = 'new' AND score >= 6.0 AND source_id = 'slack') "
       "SELECT d.message_id, coalesce(r.i <= 50, false) AS leased, CASE WHEN r.i <= 50 THEN 'processing' ELSE now_status END AS status, CASE WHEN r.i <= 50 THEN 1 ELSE 0 END AS lease_attempts "
       "FROM d LEFT JOIN r USING (message_id)")
def lease_candidates(spark, sf_dir):
    return C.lease(candidates(spark, sf_dir), NOW, 50, 6.0, "slack").select("message_id", "leased", "status", "lease_attempts")


@query(L.SCORED + " SELECT message_id, CASE WHEN event_id = 8 THEN 'llm_ok' ELSE status END AS status FROM k")
def candidate_status(spark, sf_dir):
    key = F.sha1(F.lit("C_x|8"))
    c = candidates(spark, sf_dir).withColumn("message_id", F.when(F.col("event_id") == 8, key).otherwise(F.col("message_id")))
    done = C.set_status(c, hashlib.sha1(b"C_x|8").hexdigest(), "llm_ok", NOW)
    back = F.sha1(F.concat(F.col("channel"), F.lit("|"), F.col("event_id").cast("string")))
    return done.select(back.alias("message_id"), "status")


# Filters and ordered reads


def _events_query(where: str, order: str = "", more: str = "") -> str:
    return f"{L.EVENTS_SQL} SELECT event_id FROM e WHERE {where} {('ORDER BY ' + order) if order else ''} {more}"


@query(_events_query(f"{L.SORT_TIME} BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' AND category IN ('product', 'risk') AND confidence BETWEEN 0.3 AND 0.9 AND source_channel IN ('C1', 'C2') AND source_id = 'slack'",
                     "extracted_at DESC, event_id", "LIMIT 40 OFFSET 5"))
def events_by_criteria(spark, sf_dir):
    c = Q.EventCriteria(start=START, end=END, categories=("product", "risk"), min_confidence=0.3, max_confidence=0.9, source_channels=("C1", "C2"), source_id="slack", limit=40, offset=5)
    return c.apply(events(spark, sf_dir)).select("event_id")


@query(_events_query("extracted_at >= TIMESTAMP '1993-01-01' AND extracted_at <= TIMESTAMP '1998-06-01' AND message_id IN ('m1', 'm5', 'm77')"))
def events_by_extraction(spark, sf_dir):
    return Q.EventCriteria(extracted_after=datetime(1993, 1, 1), extracted_before=datetime(1998, 6, 1), message_ids=("m1", "m5", "m77"), offset=3).apply(events(spark, sf_dir)).select("event_id")


@query(_events_query("extracted_at >= TIMESTAMP '1998-07-25'"))
def recent_events_preset(spark, sf_dir):
    return Q.recent_events(datetime(1998, 8, 1)).apply(events(spark, sf_dir)).select("event_id")


@query(_events_query(f"{L.SORT_TIME} BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' AND category = 'product' AND confidence >= 0.7"))
def product_events_preset(spark, sf_dir):
    return Q.product_events(START, END).apply(events(spark, sf_dir)).select("event_id")


@query(L.SCORED + " SELECT message_id FROM k WHERE score BETWEEN 5 AND 40 AND status = 'new' AND channel = 'C_click' AND ts_dt >= TIMESTAMP '2024-01-05' AND len(links_norm) > 0 AND len(anchors) = 0 ORDER BY score DESC, message_id LIMIT 30")
def candidates_by_criteria(spark, sf_dir):
    c = Q.CandidateCriteria(min_score=5.0, max_score=40.0, status="new", channel="C_click", after=datetime(2024, 1, 5), has_links=True, has_anchors=False, limit=30)
    return c.apply(candidates(spark, sf_dir)).select("message_id")


@query(L.SCORED + " SELECT message_id FROM k WHERE status = 'new' AND score >= 15")
def high_priority_preset(spark, sf_dir):
    return Q.high_priority().apply(candidates(spark, sf_dir)).select("message_id")


@query(L.SCORED + " SELECT message_id FROM k WHERE status = 'new' AND score >= 8 AND (len(links_norm) > 0 OR len(anchors) > 0)")
def promising_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).where(Q.promising_candidate(8.0)).select("message_id")


@query(_events_query("NOT (category = 'product' AND confidence >= 0.7) AND (list_contains(source_channels, 'C1') OR extracted_at >= TIMESTAMP '1997-01-01') AND object_id IS NULL"))
def event_specifications(spark, sf_dir):
    spec = Q.all_of(Q.negated(Q.sure_product()), Q.any_of(Q.event_channel("C1"), Q.recent(datetime(1997, 1, 8), 7)), Q.negated(F.col("object_id") == "wallet.stocks"))
    return events(spark, sf_dir).where(spec).select("event_id")


@query(f"WITH {L.M} SELECT message_id FROM m WHERE NOT is_bot AND reactions_count >= 3 AND channel = 'C_view'")
def message_specifications(spark, sf_dir):
    return messages(spark, sf_dir).where(Q.all_of(Q.negated(Q.is_bot()), Q.reactions_at_least(3), Q.message_channel("C_view"))).select("message_id")


@query(_events_query(f"{L.EVENT_TIME} BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31'"))
def event_window(spark, sf_dir):
    return Q.in_window(events(spark, sf_dir), START, END).select("event_id")


@query(_events_query(f"{L.EVENT_TIME} BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' AND confidence >= 0.6", f"{L.EVENT_TIME}, event_id", "LIMIT 25"))
def event_window_filtered(spark, sf_dir):
    return Q.in_window(events(spark, sf_dir), START, END, 0.6, 25).select("event_id")


@query(_events_query("source_id = 'telegram'", "extracted_at DESC, event_id", "LIMIT 30"))
def events_of_source(spark, sf_dir):
    return Q.events_by_source(events(spark, sf_dir), "telegram", 30).select("event_id")


@query(L.SCORED + " SELECT message_id FROM k WHERE source_id = 'telegram' ORDER BY score DESC, ts_dt DESC, message_id LIMIT 30")
def candidates_of_source(spark, sf_dir):
    return Q.candidates_by_source(candidates(spark, sf_dir), "telegram", 30).select("message_id")


@query(f"{L.EVENTS_SQL} SELECT event_id FROM e WHERE {L.CLUSTER} = (SELECT {L.CLUSTER} FROM e WHERE k = 4)")
def events_of_cluster(spark, sf_dir):
    e = events(spark, sf_dir)
    key = e.where("k = 4").select("cluster_key").first()
    return Q.events_by_cluster(e, key[0]).select("event_id")


@query(f"WITH {L.M} SELECT message_id, channel FROM m ORDER BY ts_dt DESC, message_id LIMIT 25")
def recent_messages(spark, sf_dir):
    return Q.recent_messages(messages(spark, sf_dir), 25).select("message_id", "channel")


@query(f"WITH {L.M} SELECT message_id FROM m WHERE channel = 'C_view' ORDER BY ts_dt DESC, message_id LIMIT 25")
def channel_messages(spark, sf_dir):
    return Q.channel_messages(messages(spark, sf_dir), "C_view", 25).select("message_id")


@query(_events_query("true", "extracted_at DESC, event_id", "LIMIT 25"))
def last_events(spark, sf_dir):
    return Q.last_extracted(events(spark, sf_dir), 25).select("event_id")


@query(f"{L.EVENTS_SQL} SELECT e.event_id, 'updates' AS relation_type FROM e WHERE k IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def related_events(spark, sf_dir):
    edges = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_event_id"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0").alias("target_event_id"), F.lit("updates").alias("relation_type")).distinct()
    return Q.related_events(events(spark, sf_dir), edges, 3).select("event_id", "relation_type")


# Keys, titles, importance, validation


@query(f"{L.EVENTS_SQL} SELECT event_id, {L.CLUSTER} AS cluster_key, {L.DEDUP} AS dedup_key FROM e")
def event_keys(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "cluster_key", "dedup_key")


@query(f"{L.EVENTS_SQL} SELECT event_id, {L.TITLE} AS canonical, replace({L.TITLE}, action || ': ' || object_name_raw, object_name_raw || ': ' || action) AS object_first, CASE WHEN category = 'risk' THEN {L.RISK_TITLE} ELSE {L.TITLE} END AS severity_first FROM e")
def titles(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", *[E.title(s).alias(s) for s in ("canonical", "object_first", "severity_first")])


_AGE = f"(epoch(TIMESTAMP '1996-06-01') - epoch({L.EVENT_TIME})) / 86400.0::DOUBLE"
_FIRST = "CAST(round_even(0.6::DOUBLE * h + 0.4::DOUBLE * (0.5::DOUBLE * 100.0::DOUBLE), 0) AS DOUBLE)"


@query(f"{L.EVENTS_SQL}, h AS (SELECT *, {L.HEURISTIC} AS h FROM e), i AS (SELECT event_id, h, greatest(0, least(100, CASE WHEN k % 10 = 0 THEN greatest(x - 20, 0) ELSE x END)) AS importance FROM "
       f"(SELECT *, CASE WHEN {L.EVENT_TIME} IS NOT NULL AND {_AGE} > 7 THEN CAST(trunc({_FIRST} * pow(0.9::DOUBLE, {_AGE} / 7.0::DOUBLE)) AS INTEGER) ELSE CAST({_FIRST} AS INTEGER) END AS x FROM h)) "
       "SELECT event_id, h AS heuristic, importance, CASE WHEN importance >= 80 THEN 'critical' WHEN importance >= 60 THEN 'high' WHEN importance >= 40 THEN 'medium' ELSE 'low' END AS label FROM i")
def importance(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("h", E.heuristic((F.col("k") % 13).cast("int"), (F.col("k") % 5).cast("int")))
    i = e.withColumn("i", E.importance(F.col("h"), datetime(1996, 6, 1), duplicate=F.col("k") % 10 == 0))
    return i.select("event_id", F.col("h").alias("heuristic"), F.col("i").alias("importance"), E.importance_label(F.col("i")).alias("label"))


@query(f"{L.EVENTS_SQL} SELECT event_id, array_to_string({L.ISSUES}, '|') AS issues, CAST(len({L.CRITICAL}) AS INTEGER) AS n_critical, confidence >= 0.6 AND importance >= 60 AND len({L.CRITICAL}) = 0 AS publish FROM e")
def validation(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", joined(E.all_issues()).alias("issues"), F.size(E.critical_issues()).alias("n_critical"), E.should_publish().alias("publish"))


@query(f"{L.EVENTS_SQL} SELECT event_id, CAST(len({L.CRITICAL}) AS INTEGER) AS errors, CASE WHEN category = 'unknown' THEN 1 ELSE 0 END + CASE WHEN confidence < 0.6 THEN 1 ELSE 0 END AS warnings, CASE WHEN importance < 60 THEN 1 ELSE 0 END AS infos FROM e")
def quality(spark, sf_dir):
    q = E.quality_issues()
    return events(spark, sf_dir).select("event_id", F.size(q["errors"]).alias("errors"), F.size(q["warnings"]).alias("warnings"), F.size(q["info"]).alias("infos"))


# Digest

_DIGEST = (
    f"{L.EVENTS_SQL}, w AS (SELECT * FROM e WHERE {L.EVENT_TIME} BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' AND confidence >= 0.5 "
    f"ORDER BY {L.SORT_TIME}, {L.CATEGORY_ORDER}, importance DESC, event_id LIMIT 120), g AS (SELECT *, row_number() OVER (ORDER BY {L.SORT_TIME}, {L.CATEGORY_ORDER}, importance DESC, event_id) AS r FROM w WHERE len({L.CRITICAL}) = 0)"
)


@query(f"{_DIGEST} SELECT event_id, confidence >= 0.8 AS sure FROM g")
def digest_events(spark, sf_dir):
    return digest.digest_events(events(spark, sf_dir), START, END, 0.5, 120).select("event_id", (E.confidence_icon(F.col("confidence")) == "✅").alias("sure"))


@query(f"{_DIGEST}, b AS (SELECT 1 AS pos, 'header' AS kind, 'Events 01.06.1996' AS text UNION ALL SELECT 2, 'divider', '' UNION ALL "
       f"SELECT r + 2, 'section', {L.EMOJI} || ' ' || CASE WHEN category = 'risk' THEN {L.RISK_TITLE} ELSE {L.TITLE} END FROM g UNION ALL SELECT n + 3, 'divider', '' FROM (SELECT count(*) AS n FROM g) WHERE n > 0 "
       "UNION ALL SELECT n + 4, 'context', 'Total events: *' || n || '*' FROM (SELECT count(*) AS n FROM g) WHERE n > 0 UNION ALL SELECT 3, 'section', '_No new events._' FROM (SELECT count(*) AS n FROM g) WHERE n = 0) "
       "SELECT CAST(pos AS BIGINT) AS pos, kind, text, CAST((pos - 1) // 50 AS INTEGER) AS chunk FROM b")
def digest_blocks(spark, sf_dir):
    return digest.blocks(digest.digest_events(events(spark, sf_dir), START, END, 0.5, 120), digest.header_text(datetime(1996, 6, 1)))


# Aggregates


@query("SELECT coalesce(sum(value), 0.0) AS cost FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def daily_cost(spark, sf_dir):
    return S.spent(V.table(spark, sf_dir, "events"), datetime(2024, 1, 10, 15), "value")


@query(f"WITH {L.M} SELECT channel, max(epoch_us(ts_dt) / 1e6) AS top FROM m GROUP BY channel")
def channel_tops(spark, sf_dir):
    return S.highest(messages(spark, sf_dir).withColumn("ts_num", F.unix_micros("ts_dt") / 1e6), "ts_num")


@query(f"WITH {L.M} SELECT source_id, count(*) AS messages, sum(reactions_count) AS reactions, sum(reply_count) AS replies, count(DISTINCT channel) AS channels FROM m GROUP BY source_id")
def source_totals(spark, sf_dir):
    m = messages(spark, sf_dir).groupBy("source_id")
    return m.agg(F.count("*").alias("messages"), F.sum("reactions_count").alias("reactions"), F.sum("reply_count").alias("replies"), F.countDistinct("channel").alias("channels"))


@query(f"{L.EVENTS_SQL} SELECT count(*) AS n, count(DISTINCT category) AS categories, CAST(floor((epoch(max({L.SORT_TIME})) - epoch(min({L.SORT_TIME}))) / 86400) AS BIGINT) AS days FROM e")
def event_overview(spark, sf_dir):
    t = E.sort_time()
    return events(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("category").alias("categories"), F.floor((F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / 86_400_000_000).alias("days"))


@query(f"{L.EVENTS_SQL} SELECT category, {L.CATEGORY_ORDER} AS place, count(*) AS n FROM e GROUP BY ALL")
def events_by_category(spark, sf_dir):
    return events(spark, sf_dir).groupBy("category", E.category_order().alias("place")).agg(F.count("*").alias("n"))


@query(f"{L.EVENTS_SQL} SELECT event_id, {L.SORT_TIME} AS starts, {L.SORT_TIME} + INTERVAL 1 DAY AS ends FROM e")
def timeline(spark, sf_dir):
    t = E.sort_time()
    return events(spark, sf_dir).select("event_id", t.cast("timestamp_ntz").alias("starts"), (t + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("ends"))


# State


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS v, o_orderpriority AS kept FROM orders")
def upsert(spark, sf_dir):
    """Every order: even ones are stored, odd ones and multiples of three are put in, some rows twice."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("kept"))
    target = o.where("k % 2 = 0").withColumn("v", F.lit("old"))
    fresh = o.where("k % 2 = 1 OR k % 3 = 0")
    new = fresh.select("k", F.when(F.col("k") % 2 == 0, "lost").otherwise(F.col("kept")).alias("kept"), F.lit("new").alias("v"), F.lit(1).alias("seq"))
    stale = new.withColumn("v", F.lit("stale")).withColumn("seq", F.lit(0))
    return S.upsert(target, new.unionByName(stale), ["k"], [F.col("seq")], keep=["kept"]).select("k", "v", "kept")


@query("SELECT DISTINCT l_orderkey AS source_event_id, 'updates' AS relation_type, l_partkey AS target_event_id FROM lineitem")
def upsert_relations(spark, sf_dir):
    r = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_event_id"), F.lit("updates").alias("relation_type"), F.col("l_partkey").alias("target_event_id"))
    return S.upsert(r.where("source_event_id % 2 = 0").distinct(), r, ["source_event_id", "relation_type", "target_event_id"])


@query(f"WITH {L.M} SELECT message_id FROM m WHERE channel <> 'C_click' AND ts_dt > TIMESTAMP '2024-01-15' OR channel = 'C_view' OR channel = 'C_click'")
def after_watermark(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("ts_num", F.unix_micros("ts_dt") / 1e6)
    marks = m.select("channel").distinct().where("channel <> 'C_click'").withColumn("max_processed_ts", (F.unix_micros(F.lit("2024-01-15").cast("timestamp")) / 1e6))
    states = marks.withColumn("resume_cursor", F.when(F.col("channel") == "C_view", "page2"))
    return S.after_watermark(m, states).select("message_id")


_CALLS = "SELECT event_id AS id, 'p' || (user_id % 40) AS prompt_hash, ts, CASE WHEN event_id % 4 <> 0 THEN 'r' || event_id END AS response_json FROM events"


def _calls(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 40).alias("prompt_hash"), "ts", F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("response_json"))


@query(f"WITH c AS ({_CALLS}), l AS (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY ts DESC, id DESC) AS r FROM c WHERE response_json IS NOT NULL) SELECT prompt_hash, response_json FROM l WHERE r = 1 AND ts >= TIMESTAMP '2024-01-30 00:00:00'")
def cached_replies(spark, sf_dir):
    return S.cached_reply(_calls(spark, sf_dir), datetime(2024, 1, 31), timedelta(days=1))


@query(f"WITH c AS ({_CALLS}), l AS (SELECT prompt_hash, max(ts) AS t FROM c WHERE response_json IS NOT NULL GROUP BY 1) SELECT c.id, CASE WHEN l.t < TIMESTAMP '2024-01-30 00:00:00' OR c.prompt_hash = 'p3' THEN NULL ELSE response_json END AS response_json FROM c LEFT JOIN l USING (prompt_hash)")
def expired_replies(spark, sf_dir):
    return S.invalidate(S.expire(_calls(spark, sf_dir), datetime(2024, 1, 31), timedelta(days=1)), "p3").select("id", "response_json")


@query(f"WITH c AS ({_CALLS}), l AS (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY ts DESC, id DESC) AS r FROM c) SELECT id, CASE WHEN r = 1 AND prompt_hash IN ('p1', 'p2') THEN 'new ' || prompt_hash ELSE response_json END AS response_json FROM l")
def attached_replies(spark, sf_dir):
    r = spark.createDataFrame([("p1", "new p1"), ("p2", "new p2")], "prompt_hash string, reply string")
    return S.attach_reply(_calls(spark, sf_dir), r).select("id", "response_json")


_TASKS = "SELECT 't' || o_orderkey AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'llm' ELSE 'dedup' END AS task_type, CAST(o_orderkey % 4 AS INTEGER) AS priority, CAST(o_orderdate AS TIMESTAMP) AS run_at, CASE WHEN o_orderkey % 5 = 0 THEN 'done' ELSE 'queued' END AS status, CAST(o_orderkey % 3 AS INTEGER) AS attempts, 'k' || o_orderkey AS idempotency_key FROM orders"


def _tasks(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    none = lambda t: F.lit(None).cast(t)
    return o.select(
        text("t").alias("task_id"), F.when(k % 3 == 0, "ingest").when(k % 3 == 1, "llm").otherwise("dedup").alias("task_type"), F.lit("{}").alias("payload"), (k % 4).cast("int").alias("priority"), F.col("o_orderdate").alias("run_at"),
        F.when(k % 5 == 0, "done").otherwise("queued").alias("status"), (k % 3).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), text("k").alias("idempotency_key"), none("string").alias("last_error"),
        none("timestamp").alias("locked_at"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    )


@query(f"WITH t AS ({_TASKS}) SELECT task_type, status, count(*) AS n FROM t GROUP BY ALL")
def queue_depth(spark, sf_dir):
    return S.queue_depth(_tasks(spark, sf_dir))


@query(f"WITH t AS ({_TASKS}), d AS (SELECT task_id, row_number() OVER (ORDER BY priority, run_at, task_id) AS r FROM t WHERE status = 'queued' AND task_type = 'llm' AND run_at <= TIMESTAMP '1997-01-01') "
       "SELECT t.task_id, coalesce(r <= 20, false) AS leased, CASE WHEN r <= 20 THEN 'in_progress' ELSE status END AS status, attempts + CASE WHEN r <= 20 THEN 1 ELSE 0 END AS attempts FROM t LEFT JOIN d USING (task_id)")
def lease_tasks(spark, sf_dir):
    return S.lease_tasks(_tasks(spark, sf_dir), "llm", datetime(1997, 1, 1), 20).select("task_id", "leased", "status", "attempts")


@query(f"WITH t AS ({_TASKS}) SELECT idempotency_key, place FROM (SELECT idempotency_key, 1 AS place FROM t UNION ALL SELECT 'x' || i, 0 FROM range(3) r(i))")
def enqueue_tasks(spark, sf_dir):
    """A batch that asks for every task that exists and three new ones."""
    t = _tasks(spark, sf_dir)
    cols = ["task_type", "payload", "priority", "run_at", "max_attempts", "idempotency_key"]
    fresh = spark.range(3).select(F.lit("llm").alias("task_type"), F.lit("{}").alias("payload"), F.lit(1).alias("priority"), F.lit(NOW).cast("timestamp").alias("run_at"), F.lit(3).alias("max_attempts"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("idempotency_key"))
    _, asked = S.enqueue(t, t.select(*cols).unionByName(fresh), NOW)
    return asked.select("idempotency_key", "place")


@query(f"WITH t AS ({_TASKS}) SELECT task_id, CASE task_id WHEN 't3' THEN 'done' WHEN 't4' THEN 'queued' ELSE status END AS status, CASE WHEN task_id = 't4' THEN TIMESTAMP '2024-01-20 12:00:00' ELSE run_at END AS run_at, least(300.0, pow(2.0, greatest(attempts - 1, 0))) AS delay FROM t")
def finish_tasks(spark, sf_dir):
    t = S.finish_task(S.finish_task(_tasks(spark, sf_dir), "t3", NOW), "t4", NOW, "boom", NOW)
    return t.select("task_id", "status", F.col("run_at").cast("timestamp_ntz").alias("run_at"), S.retry_delay(F.col("attempts")).alias("delay"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) < 3 AS allowed FROM events")
def rate_limit(spark, sf_dir):
    return S.too_frequent(V.table(spark, sf_dir, "events"), "user_id", "ts", 3, 6 * 3600).select("event_id", "allowed")


# Feeds and streams


_TS = "CAST(epoch_us(date_trunc('second', ts_dt)) // 1000000 AS VARCHAR) || '.000000'"


def _slack_raw(spark, sf_dir):
    m = V.messages(spark, sf_dir).where("source_id = 'slack'")
    ts = F.concat(F.floor(F.unix_micros("ts_dt") / 1_000_000).cast("string"), F.lit(".000000"))
    even = F.col("event_id") % 2 == 0
    block = F.concat(F.lit('[{"type":"section","text":{"text":"block '), F.col("event_id").cast("string"), F.lit('"}}]'))
    return m.select(
        "channel", ts.alias("ts"), F.when(F.col("event_id") % 10 == 1, "1.0").alias("thread_ts"), F.col("user_id").alias("user"), "bot_id", F.when(F.col("event_id") % 7 == 0, "bot_message").alias("subtype"), "text", F.when(even, block).alias("blocks"), "reply_count",
        F.array(F.struct(F.lit("a").alias("name"), F.lit(1).alias("count")), F.struct(F.lit("").alias("name"), F.lit(9).alias("count")), F.struct(F.lit("a").alias("name"), F.col("reactions_count").alias("count"))).alias("reactions"),
        F.when(even, F.array(F.lit("x"))).alias("attachments"), F.lit(None).cast("array<string>").alias("files"), F.struct(F.lit("5").alias("ts"), F.lit("u").alias("user")).alias("edited"),
    )


@query(f"WITH {L.M} SELECT sha1(channel || '|' || {_TS}) AS message_id, date_trunc('second', ts_dt) AS ts_dt, bot_id IS NOT NULL OR event_id % 7 = 0 AS is_bot, CASE WHEN event_id % 2 = 0 THEN 'block ' || event_id ELSE '' END AS blocks_text, "
       "event_id % 2 = 0 AS has_file, reactions_count AS last_count, 1 + reactions_count AS total_reactions, CASE user_id WHEN '7' THEN 'Ann' WHEN '8' THEN 'bob' END AS name FROM m WHERE source_id = 'slack' AND event_id % 10 <> 1")
def slack_feed(spark, sf_dir):
    users = spark.createDataFrame([("7", "ann", None, {"display_name": "Ann"}), ("8", "bob", "", {"display_name": ""})], "user string, name string, real_name string, profile struct<real_name:string,display_name:string,email:string,image_512:string,image_192:string,image_72:string,image_48:string>")
    m = feeds.slack_messages(feeds.roots(_slack_raw(spark, sf_dir)), NOW, users)
    return m.select("message_id", F.col("ts_dt").cast("timestamp_ntz").alias("ts_dt"), "is_bot", "blocks_text", "has_file", F.col("reactions")["a"].alias("last_count"), "total_reactions", F.col("user_display_name").alias("name"))


def _telegram_raw(spark, sf_dir):
    m = V.messages(spark, sf_dir).where("source_id = 'telegram'")
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"results":[{"reaction":{"emoticon":"x"},"count":'), F.col("reactions_count").cast("string"), F.lit('},{"emoji":"y","count":-4}]}'))).when(k % 3 == 1, F.lit('{"x": 2, "y": 1}')).otherwise("like")
    known = {"channel": F.concat(F.lit("@"), F.col("channel")), "message_id": k.cast("string"), "date": F.col("ts_dt"), "text": F.col("text"), "reactions": raw, "reply_to_msg_id": F.when(k % 2 == 1, (k - 1).cast("string")), "mime_type": F.when(F.col("has_file"), "image/png"), "reply_count": F.col("reply_count"), "via_bot_id": F.when(k % 7 == 0, "9")}
    return m.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in feeds.TELEGRAM_RAW])


@query(f"WITH {L.M} SELECT sha1('@' || channel || '|' || event_id) AS message_id, 'https://t.me/' || channel || '/' || event_id AS post_url, CASE WHEN event_id % 2 = 1 THEN sha1('@' || channel || '|' || (event_id - 1)) END AS reply_to_id, "
       "CASE event_id % 3 WHEN 0 THEN reactions_count WHEN 1 THEN 3 ELSE 1 END AS reactions_count, has_file, event_id % 7 = 0 AS is_bot FROM m WHERE source_id = 'telegram'")
def telegram_feed(spark, sf_dir):
    return feeds.telegram_messages(_telegram_raw(spark, sf_dir), NOW).select("message_id", "post_url", "reply_to_id", "reactions_count", "has_file", "is_bot")


@query("SELECT event_type AS channel, date_trunc('hour', ts) AS since, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    m = raw.select(F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts_dt"), F.lit(1).alias("reactions_count"))
    name = f"hourly_{uuid.uuid4().hex}"
    counts = stream.channel_counts(m).select("channel", F.col("window.start").cast("timestamp_ntz").alias("since"), "n")
    out = f"{scratch(spark)}/{name}"

    def written(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/counts")  # all counts so far, by executors

    run = counts.writeStream.foreachBatch(written).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/counts")


# What SQL can't say


@query()
def canonical_objects(spark, sf_dir):
    registry = objects.registry(spark, REGISTRY)
    return objects.canonicalize(events(spark, sf_dir).select("event_id", "object_name_raw"), registry).select("event_id", "object_name_raw", "object_id")


@query()
def duplicate_pairs(spark, sf_dir):
    return dedup.matching_pairs(events(spark, sf_dir))


@query()
def deduplicated_events(spark, sf_dir):
    found = dedup.deduplicate(events(spark, sf_dir), columns=("event_id", "message_id", "confidence", "importance", "dedup_key", "links"))
    return found.select("event_id", "message_id", "confidence", "importance", "dedup_key", joined("links").alias("links"))


@query()
def dedup_counts(spark, sf_dir):
    e = events(spark, sf_dir)
    return dedup.dedup_counts(e, dedup.deduplicate(e, columns=("event_id",)))


def _answered(spark, sf_dir):
    c = candidates(spark, sf_dir).where("status = 'new'")
    none = spark.createDataFrame([], "prompt_hash string, response_json string")
    # written, so that no prompt goes to the extractor more than once
    return staged(extract.replies(staged(extract.prompts(c, "gpt-5-nano"), "prompts"), extract.keyword_extractor, none), "answered")


@query()
def prompt_fingerprints(spark, sf_dir):
    return extract.prompts(candidates(spark, sf_dir).where("status = 'new'"), "gpt-5-nano").select("message_id", "chunk_index", "prompt_hash")


@query()
def extracted_events(spark, sf_dir):
    e = extract.to_events(_answered(spark, sf_dir), objects.registry(spark, REGISTRY), NOW)
    return e.select("event_id", "message_id", "action", "object_name_raw", "category", "status", "importance", "cluster_key", "dedup_key")


@query()
def extraction_metrics(spark, sf_dir):
    a = _answered(spark, sf_dir)
    return extract.metrics(a, extract.to_events(a, objects.registry(spark, REGISTRY), NOW), "gpt-5-nano")
