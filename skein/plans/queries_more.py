"""More registered queries: caches, positions, keys, title pairs and prompts, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from skein.functions import events as E
from skein.functions import text as X
from skein.operators import candidates as C
from skein.operators import dedup, objects
from skein.operators import state as S
from skein.plans import fixtures as V
from skein.plans import jobs, pipeline
from skein.plans import sql as L
from skein.plans.queries import _TASKS, NOW, REGISTRY, SQL, _tasks, candidates, events, joined, messages, query
from skein.sources import feeds, tables

# Anchors and texts

_REF = "CAST(page_id AS VARCHAR(20))"
_LINKED = f"""SELECT page_id, CASE page_id % 5
 WHEN 0 THEN 'teams.microsoft.com/l/meetup-join/' || {_REF} || ' zoom.us/j/' || {_REF} || ' AB-' || {_REF} || ' AB-' || {_REF}
 WHEN 1 THEN 'https://docs.google.com/a/b/document/d/1234567890_abcdefghijklmnop-' || {_REF} || '/edit github.com/a/b/pull/' || {_REF}
 WHEN 2 THEN 'notion.so/team/Page-' || md5({_REF}) || ' confluence.acme.io/pages/viewpage.action?pageId=' || {_REF} || ' confluence.acme.io/display/ENG/77'
 WHEN 3 THEN 'gitlab.com/a/b/-/merge_requests/' || {_REF} || ' then meet.google.com/abc-defg-hij and GH-' || {_REF}
 ELSE coalesce(url, '') END AS text FROM pages"""


@query(f"WITH n AS ({_LINKED}) SELECT page_id, array_to_string(list_filter({L.FAMILIES}, lambda x, i: list_position({L.FAMILIES}, x) = i), '|') AS anchors FROM n")
def anchor_families(spark, sf_dir):
    """Every family, in its order and the order of first sight."""
    V.table(spark, sf_dir, "pages").createOrReplaceTempView("pages_linked")
    return spark.sql(_LINKED.replace("FROM pages", "FROM pages_linked")).select("page_id", joined(X.anchors(F.col("text"))).alias("anchors"))


@query(f"WITH {L.M} SELECT message_id, CASE event_id % 4 WHEN 0 THEN text WHEN 1 THEN 'intro: ' || text WHEN 2 THEN text || ' other words' ELSE text END AS whole FROM m")
def combined_texts(spark, sf_dir):
    m = messages(spark, sf_dir)
    k = F.col("event_id") % 4
    blocks = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("intro: "), "text")).when(k == 2, "other words")
    return m.select("message_id", X.combine(F.col("text"), blocks).alias("whole"))


_SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LAST = "CASE WHEN contains(left(rest, {n}), ' ') THEN {n} - strpos(reverse(left(rest, {n})), ' ') ELSE -1 END"
_CUT = "CASE WHEN {last} >= {n} // 2 THEN {last} ELSE {n} END"


def _first_part(n: int) -> str:
    cut = _CUT.format(last="(" + _LAST.format(n=n) + ")", n=n)
    return f"regexp_replace(left(rest, {cut}), '{_SPACES}+$', '')"


SQL["chunks"] = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, -1 AS pos, '' AS chunk, regexp_replace(regexp_replace(coalesce(text, ''), '^{_SPACES}+', ''), '{_SPACES}+$', '') AS rest, true AS more FROM documents
  UNION ALL
  SELECT doc_id, pos + 1, CASE WHEN length(rest) <= 1500 THEN rest ELSE part || CASE WHEN length(part) <= 1498 THEN ' …' ELSE '' END END,
    CASE WHEN length(rest) <= 1500 THEN '' ELSE regexp_replace(substr(rest, length(part) + 1), '^{_SPACES}+', '') END, length(rest) > 1500
  FROM (SELECT *, CASE WHEN length({_first_part(1500)}) <= 1498 THEN {_first_part(1500)} ELSE {_first_part(1498)} END AS part FROM t WHERE more)
) SELECT doc_id, CAST(pos AS INTEGER) AS pos, chunk FROM t WHERE pos >= 0
"""

_PROMPT = (
    "'{\"channel\":' || to_json(channel_name) || ',\"links\":' || CASE WHEN len(links_norm) = 0 THEN '[]' ELSE CAST(to_json(links_norm[1:3]) AS VARCHAR) END"
    " || ',\"text\":' || to_json(text_norm) || ',\"ts\":\"' || CASE WHEN epoch_us(ts_dt) % 1000000 = 0 THEN strftime(ts_dt, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts_dt, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00\"}'"
)
SQL["prompt_fingerprints"] = f"{L.SCORED} SELECT message_id, 0 AS chunk_index, sha256('gpt-5-nano|v1||0|' || sha256({_PROMPT})) AS prompt_hash FROM k WHERE status = 'new'"


# Names and titles: the similarity is twice the longest common subsequence over both lengths

_LCS = (
    "list_last(list_reduce(string_split({b}, ''), lambda row, c: list_reduce(range(1, length({a}) + 1), "
    "lambda new, j: list_append(new, CASE WHEN substr({a}, CAST(j AS BIGINT), 1) = c THEN row[j] + 1 ELSE greatest(row[j + 1], new[j]) END), [CAST(0 AS BIGINT)]), "
    "list_transform(range(0, length({a}) + 1), lambda i: CAST(0 AS BIGINT))))"
)
_RATIO = "(2.0::DOUBLE * " + _LCS + " / (length({a}) + length({b})))"

_SYNONYMS = ", ".join(f"('{s.lower().strip()}', '{o}', {i})" for i, (o, s) in enumerate((o, s) for o, ss in REGISTRY.items() for s in ss))
_NAMED = f"""r AS (SELECT * FROM (VALUES {_SYNONYMS}) AS v(synonym, object_id, ord)),
d AS (SELECT DISTINCT trim(lower(object_name_raw)) AS n FROM e),
f AS (SELECT n, object_id, CASE WHEN n = synonym THEN 2.0 ELSE {_RATIO.format(a='n', b='synonym')} END AS s, ord FROM d, r WHERE n <> '' AND length(n) * 9 <= length(synonym) * 11 AND length(synonym) * 9 <= length(n) * 11),
g AS (SELECT n, object_id FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY s DESC, ord) AS k FROM f WHERE s >= 0.9) WHERE k = 1)"""
SQL["canonical_objects"] = f"{L.EVENTS_SQL}, {_NAMED} SELECT event_id, object_name_raw, g.object_id FROM e LEFT JOIN g ON trim(lower(object_name_raw)) = g.n"

_SIDES = f"""t AS (SELECT event_id, message_id, source_id, {L.EVENT_TIME} AS at, list_distinct(list_concat(anchors, links)) AS keys, {L.TITLE} AS title FROM e),
x AS (SELECT * EXCLUDE (keys), unnest(keys) AS key FROM t),
y AS (SELECT DISTINCT a.event_id AS left_id, b.event_id AS right_id, a.title AS a, b.title AS b FROM x a JOIN x b ON a.key = b.key AND a.source_id = b.source_id AND a.event_id < b.event_id AND a.message_id <> b.message_id
  AND (a.at IS NULL OR b.at IS NULL OR abs(epoch(a.at) - epoch(b.at)) <= 48 * 3600)),
z AS (SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE {_RATIO.format(a='a', b='b')} END AS similarity FROM (SELECT DISTINCT a, b FROM y))"""
_PAIRS = f"{L.EVENTS_SQL}, {_SIDES} SELECT left_id, right_id, similarity FROM y JOIN z USING (a, b) WHERE similarity >= 0.8"
SQL["duplicate_pairs"] = _PAIRS


@query(f"WITH p AS ({_PAIRS}) SELECT left_id AS new_id, right_id AS stored_id FROM p WHERE CAST(left_id AS BIGINT) % 10 = 0 AND CAST(right_id AS BIGINT) % 10 <> 0 UNION ALL SELECT right_id, left_id FROM p WHERE CAST(right_id AS BIGINT) % 10 = 0 AND CAST(left_id AS BIGINT) % 10 <> 0")
def stored_matches(spark, sf_dir):
    """All stored events that a new one matches."""
    e = events(spark, sf_dir)
    fresh = F.col("event_id").cast("long") % 10 == 0
    return dedup.matching_stored(e.where(fresh), e.where(~fresh)).select("new_id", "stored_id")


_LONG = "repeat(object_name_raw || ' ', CAST(k % 12 AS INTEGER))"
_STEPS = [
    "{head} || {quoted2} || {stroke} || {anchor}", "{head} || {quoted2} || {anchor}", "{head} || {quoted1} || {anchor}", "{head} || {quoted1}", "{head}",
]


def _long_title() -> str:
    parts = {
        "head": "action || ': ' || name", "quoted1": "CASE WHEN n_qualifiers > 0 THEN ' — ' || qualifiers[1] ELSE '' END", "quoted2": "CASE WHEN n_qualifiers > 0 THEN ' — ' || array_to_string(qualifiers[1:2], ', ') ELSE '' END",
        "stroke": "CASE WHEN stroke IS NOT NULL THEN ', ' || stroke ELSE '' END", "anchor": "CASE WHEN anchor IS NOT NULL THEN ' (' || anchor || ')' ELSE '' END",
    }
    tries = " ".join(f"WHEN length({s.format(**parts)}) <= 140 THEN {s.format(**parts)}" for s in _STEPS)
    return f"CASE {tries} ELSE action || ': ' || left(name, 136 - length(action)) || '...' END"


@query(f"{L.EVENTS_SQL}, n AS (SELECT *, {_LONG} AS name FROM e) SELECT event_id, {_long_title()} AS title, CASE WHEN length({_long_title()}) > 140 THEN 'Rendered title too long: ' || length({_long_title()}) || ' chars (max 140)' ELSE '' END AS issue FROM n")
def long_titles(spark, sf_dir):
    """The cascade of shortened titles, and the check of the rendered one."""
    e = events(spark, sf_dir).withColumn("object_name_raw", F.expr("repeat(concat(object_name_raw, ' '), CAST(k % 12 AS INT))"))
    long = F.filter(E.structure_issues(), lambda x: x.startswith("Rendered"))
    return e.select("event_id", E.title().alias("title"), F.coalesce(F.get(long, F.lit(0)), F.lit("")).alias("issue"))


@query(f"{L.EVENTS_SQL} SELECT issue, count(*) AS n FROM (SELECT unnest({L.ISSUES}) AS issue FROM e) GROUP BY 1")
def validation_report(spark, sf_dir):
    return pipeline.validation_report(events(spark, sf_dir))


@query(f"WITH {L.M} SELECT source_id, count(*) AS messages, count(*) FILTER (event_id % 6 = 0) AS edited FROM m GROUP BY 1")
def edited_totals(spark, sf_dir):
    """How many messages of a source were edited."""
    m = messages(spark, sf_dir).withColumn("edited_ts", F.when(F.col("event_id") % 6 == 0, F.col("ts_dt").cast("string")))
    return m.groupBy("source_id").agg(F.count("*").alias("messages"), F.count("edited_ts").alias("edited"))


# State


@query(f"{L.EVENTS_SQL}, d AS (SELECT event_id, {L.DEDUP} AS dedup_key, importance FROM e), o AS (SELECT dedup_key, min(event_id) AS event_id, max(event_id) AS last FROM d GROUP BY 1) SELECT o.event_id, o.dedup_key, d.importance + 1 AS importance FROM o JOIN d ON d.event_id = o.last")
def upsert_events(spark, sf_dir):
    """Events put in by their dedup key: the stored id stays, all else is the newest one's."""
    e = events(spark, sf_dir).select("event_id", "dedup_key", "importance")
    stored = S.latest(e, ["dedup_key"], [-F.col("event_id").cast("long")])
    new = e.withColumn("importance", F.col("importance") + 1)
    return S.upsert(stored, new, ["dedup_key"], [F.col("event_id")], keep=["event_id"]).select("event_id", "dedup_key", "importance")


@query("SELECT CAST(c_custkey AS VARCHAR) AS user, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name FROM customer")
def user_cache(spark, sf_dir):
    """Cached users after new ones are put in, read back from JSON; nonsense reads as null."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user"), "c_name", F.col("c_custkey").alias("k"))
    json = lambda name: F.to_json(F.struct(name.alias("name")))
    old = c.select("user", F.when(F.col("k") % 5 == 0, "{broken").otherwise(json(F.col("c_name"))).alias("value"))
    new = c.where("k % 3 = 0").select("user", json(F.concat(F.lit("new "), "c_name")).alias("value"))
    found = tables.lookup(c.select("user"), S.upsert(old, new, ["user"]), "user", "name string")
    return found.select("user", F.col("value.name").alias("name"))


@query("SELECT event_type AS channel, CASE event_type WHEN 'click' THEN 100.0 ELSE epoch_us(max(ts)) / 1e6 END AS max_processed_ts, CASE event_type WHEN 'click' THEN 'page3' END AS resume_cursor, CASE event_type WHEN 'click' THEN 5.0 END AS resume_min_ts FROM events GROUP BY 1")
def advanced_states(spark, sf_dir):
    """Watermarks after a fetch: one channel has more to fetch and keeps its own."""
    e = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_num"))
    kinds = e.select("channel").distinct()
    states = kinds.select("channel", F.lit(100.0).alias("max_processed_ts"), F.lit(None).cast("string").alias("resume_cursor"), F.lit(None).cast("double").alias("resume_min_ts"), F.lit(NOW).cast("timestamp").alias("updated_at"))
    more = F.col("channel") == "click"
    cursors = kinds.select("channel", F.when(more, "page3").alias("next_cursor"), more.alias("has_more"), F.lit(5.0).alias("baseline"))
    return S.advance(states, e, cursors, NOW).select("channel", "max_processed_ts", "resume_cursor", "resume_min_ts")


@query(f"WITH {L.M} SELECT message_id FROM m WHERE CASE WHEN channel = 'C_view' THEN event_id > 500 ELSE ts_dt >= TIMESTAMP '2024-01-10' END")
def new_numbers(spark, sf_dir):
    """Messages past a channel's last number, or since a date where it has none."""
    m = messages(spark, sf_dir).withColumn("number", F.col("event_id"))
    states = spark.createDataFrame([("C_view", "500")], "channel string, last_processed_message_id string")
    return feeds.new_numbers(m, states, datetime(2024, 1, 10)).select("message_id")


@query("SELECT event_type AS channel, CASE event_type WHEN 'click' THEN 0.0 ELSE 7.0 END AS last_processed_ts, CASE event_type WHEN 'click' THEN CAST(max(event_id) AS VARCHAR) ELSE '1' END AS last_processed_message_id FROM events GROUP BY 1")
def put_positions(spark, sf_dir):
    """A time keeps the old id, an id resets the time."""
    e = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "event_id")
    old = e.select("channel", F.lit(3.0).alias("last_processed_ts"), F.lit("1").alias("last_processed_message_id")).distinct()
    timed = S.put_position(old, old.select("channel", F.lit(7.0).alias("last_processed_ts"), F.lit(None).cast("string").alias("last_processed_message_id")), by_time=True)
    ids = e.where("channel = 'click'").groupBy("channel").agg(F.max("event_id").cast("string").alias("last_processed_message_id"))
    return S.put_position(timed, ids, by_time=False)


@query("SELECT CAST(c_custkey AS VARCHAR) AS channel, CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE 1.0 END AS last_processed_ts FROM customer")
def backfilled_state(spark, sf_dir):
    """Rows of an older state table enter the new one where it has none."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("channel"), F.col("c_custkey").alias("k"))
    return S.backfill(c.where("k % 2 = 0").select("channel", F.lit(2.0).alias("last_processed_ts")), c.select("channel", F.lit(1.0).alias("last_processed_ts")), ["channel"])


@query("SELECT event_id % 4 = 0 AS bot, epoch_us(ts) / 1e6 AS n FROM events WHERE epoch_us(ts) / 1e6 > 0 ORDER BY n DESC LIMIT 25")
def newest_roots(spark, sf_dir):
    """The newest messages by number: as text, 9 would follow 10."""
    e = V.table(spark, sf_dir, "events")
    raw = e.select((F.col("event_id") % 4 == 0).alias("bot"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("n"), F.col("event_type").alias("channel"), F.lit(None).cast("string").alias("thread_ts"))
    return feeds.roots(raw.withColumn("ts", F.format_string("%.6f", "n")), oldest=0.0, limit=25).select("bot", "n")


@query(f"{L.SCORED} SELECT message_id, score FROM k WHERE message_id IN (SELECT message_id FROM m WHERE event_id IN (1, 2, 5, 8, 13, 21, 34))")
def candidates_by_message(spark, sf_dir):
    wanted = V.messages(spark, sf_dir).where(F.col("event_id").isin(1, 2, 5, 8, 13, 21, 34)).select("message_id")
    return C.by_message_id(candidates(spark, sf_dir), wanted).select("message_id", "score")


@query(f"{L.SCORED} SELECT 'llm:' || message_id AS idempotency_key, '{{\"message_id\":\"' || message_id || '\"}}' AS payload, 30 AS priority FROM k WHERE status = 'new' AND event_id % 3 = 0")
def candidate_tasks(spark, sf_dir):
    """One task for each leased candidate."""
    leased = candidates(spark, sf_dir).withColumn("leased", (F.col("status") == "new") & (F.col("event_id") % 3 == 0))
    return pipeline.llm_tasks(leased, NOW).select("idempotency_key", "payload", "priority")


@query(f"WITH t AS ({_TASKS}) SELECT task_type, count(*) AS scheduled, count(*) FILTER (status = 'done') AS done FROM t GROUP BY 1")
def schedule_counts(spark, sf_dir):
    return pipeline.schedule_counts(_tasks(spark, sf_dir))


@query("SELECT event_type AS job, CAST(CASE WHEN value <= 10 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 100 THEN 2 ELSE 3 END AS INTEGER) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def stage_histogram(spark, sf_dir):
    """How long the runs of each job took, by bounds of seconds."""
    e = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("job"), F.col("value").alias("seconds"))
    return jobs.histogram(e, "job", "seconds", [10.0, 50.0, 100.0])


@query(f"SELECT synonym, object_id FROM (VALUES {_SYNONYMS}) AS v(synonym, object_id, ord) WHERE object_id = 'pay.core'")
def synonyms(spark, sf_dir):
    r = objects.registry(spark, REGISTRY)
    return objects.synonyms_of(r, "pay.core").join(r, "synonym_norm").select(F.col("synonym_norm").alias("synonym"), "object_id")
