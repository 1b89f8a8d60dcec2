"""Incremental state, stored tables, configuration, feeds and streams."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import candidates as C
from skein.operators import criteria as Q
from skein.operators import extract, objects
from skein.operators import state as S
from skein.plans import pipeline
from skein.sources import config, feeds, tables
from skein.streaming import feeds as stream

NOW = datetime(2025, 1, 2, 12)


def test_lease_timeout(spark):
    rows = [("a", 5.0, "processing", NOW - timedelta(minutes=15)), ("b", 4.0, "processing", NOW - timedelta(minutes=15, seconds=1)), ("c", 3.0, "processing", None), ("d", 9.0, "llm_ok", None), ("e", 1.0, "new", None)]
    df = spark.createDataFrame([(*r, 0, "slack") for r in rows], "message_id string, score double, status string, processing_started_at timestamp, lease_attempts int, source_id string")
    got = {r.message_id: (r.status, r.leased, r.lease_attempts) for r in C.lease(df, NOW, 2).collect()}
    assert got == {"a": ("processing", False, 0), "b": ("processing", True, 1), "c": ("processing", True, 1), "d": ("llm_ok", False, 0), "e": ("new", False, 0)}


def test_score_cut(spark):
    for n, want in ((9, None), (10, 8.0), (20, 17.0), (25, 22.0)):
        df = spark.createDataFrame([(f"m{i}", float(i), "new") for i in range(n)], "message_id string, score double, status string")
        assert C.score_cut(df).first()[0] == want


def test_upsert_and_advance(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    s = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    got = sorted((r.k, r.v, r.w) for r in S.upsert(t, s, ["k"], [F.col("n")], keep=[]).collect())
    assert got == [(1, "a", "x"), (2, "d", None), (3, "e", None)]
    states = spark.createDataFrame([("a", 10.0, None, None), ("b", 10.0, "cur", 5.0)], "channel string, max_processed_ts double, resume_cursor string, resume_min_ts double").withColumn("updated_at", F.lit(NOW).cast("timestamp"))
    batch = spark.createDataFrame([("a", 12.0), ("a", 11.0), ("b", 20.0)], "channel string, ts_num double")
    cursors = spark.createDataFrame([("a", None, False, None), ("b", "next", True, 5.0), ("c", None, False, None)], "channel string, next_cursor string, has_more boolean, baseline double")
    got = {r.channel: (r.max_processed_ts, r.resume_cursor, r.resume_min_ts) for r in S.advance(states, batch, cursors, NOW).collect()}
    assert got == {"a": (12.0, None, None), "b": (10.0, "next", 5.0), "c": (NOW.timestamp(), None, None)}
    assert S.start_of(None, 1000000.0, 24) == 1000000.0 - 86400 and S.start_of({"resume_cursor": "x", "resume_min_ts": 3.0}, 9.0) == 3.0
    assert S.start_of({"max_processed_ts": 7.0}, 9.0) == 7.0 and S.start_of(None, 1e6, 24, 5.0) == 5.0


def test_positions_and_ttl(spark):
    s = spark.createDataFrame([("a", 1.0, "5")], "channel string, last_processed_ts double, last_processed_message_id string")
    n = spark.createDataFrame([("a", 2.0, None)], s.schema)
    assert tuple(S.put_position(s, n, True).first()) == ("a", 2.0, "5")
    m = spark.createDataFrame([("a", 3.0, "9")], s.schema)
    assert tuple(S.put_position(s, m, False).first()) == ("a", 0.0, "9")
    assert S.cache_ttl(None) == timedelta(days=21) and S.cache_ttl(0) is None and S.cache_ttl("x") == timedelta(days=21)


def test_specifications_are_never_null(spark):
    df = spark.createDataFrame([(None, None), ("product", 0.8)], "category string, confidence double")
    assert df.where(Q.negated(Q.sure_product())).count() == 1 and df.where(Q.sure_product()).count() == 1
    assert df.where(Q.EventCriteria().condition()).count() == 2
    assert Q.newest(df, [F.col("category")], 0).count() == 0


def test_versioned_table(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    t = tables.VersionedTable(spark, str(tmp_path / "t"), schema, ["k"])
    assert t.read().count() == 0
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")], [(3, "e")]):
        t.upsert(spark.createDataFrame(rows, schema))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2


def test_config(spark):
    assert config.deep_merge({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2]}) == {"a": {"b": 3, "c": 2}, "d": [2]}
    assert config.check({"a": "x"}, {"type": "object", "required": ["b"], "properties": {"a": {"type": "integer"}}}) == ["/b: missing", "/a: not of type integer"]
    assert config.check(1, None) == []
    got = config.channel_table(spark, {"slack": ["C1", {"channel_id": "C2", "threshold_score": 3, "enabled": False}, 7]}).collect()
    assert [(r.channel, r.keyword_weight, r.ord) for r in got] == [("C1", 10.0, 0)]


def landed(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"p{len(list(path.iterdir()))}.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


RAW = [
    {"channel": "C", "ts": "10.5", "text": "Release PROJ-1 https://a.example/?utm_source=x", "reactions": [{"name": "a", "count": 1}, {"name": "a", "count": 3}, {"name": "", "count": 9}], "user": "U", "files": ["f"]},
    {"channel": "C", "ts": "9.5", "thread_ts": "9.5", "text": "root", "bot_id": "B"},
    {"channel": "C", "ts": "11.5", "thread_ts": "9.5", "text": "a reply"},
]


def test_read_feed(spark, tmp_path):
    landed(tmp_path / "in", [*RAW, "{broken"])
    got = {r.ts: r for r in feeds.read_feed(spark, "slack", str(tmp_path / "in"), NOW).where("ts is not null").collect()}
    assert set(got) == {"10.5", "9.5"}
    r = got["10.5"]
    assert r.reactions == {"a": 3} and r.total_reactions == 4 and r.anchors == ["PROJ-1"] and r.links_norm == ["https://a.example/"] and r.has_file and not r.is_bot
    assert got["9.5"].is_bot and got["9.5"].user_real_name is None
    raw = feeds.read_landing(spark, str(tmp_path / "in"), feeds.SLACK_RAW).where("channel is not null")
    assert [x.ts for x in feeds.roots(raw, limit=1).collect()] == ["10.5"]


def test_stream_ingest(spark, tmp_path):
    schema = feeds.slack_messages(spark.createDataFrame([], feeds.SLACK_RAW), NOW).schema
    t = tables.VersionedTable(spark, str(tmp_path / "t"), schema, ["message_id"])
    for rows in (RAW[:2], [RAW[0] | {"text": "edited"}]):
        landed(tmp_path / "in", rows)
        stream.ingest(spark, "slack", str(tmp_path / "in"), t, str(tmp_path / "cp"), NOW).awaitTermination()
    assert sorted((r.ts, r.text) for r in t.read().collect()) == [("10.5", "edited"), ("9.5", "root")]


def test_pipeline(spark, sf_dir):
    from skein.plans import fixtures as V

    m = V.normalized(V.messages(spark, sf_dir)).where("event_id < 200")
    none = spark.createDataFrame([], "message_id string")
    new, stats = pipeline.build(m, none, V.channels(spark))
    assert stats.first().candidates_created == new.count() > 0
    calls = spark.createDataFrame([], "id long, prompt_hash string, response_json string, ts timestamp")
    reg = objects.registry(spark, {"release": ["release v2 proj-8 see"]})
    out = pipeline.extract_batch(new, calls, reg, extract.keyword_extractor, pipeline.Settings(), NOW, 0.0)
    leased, answered, found = out
    assert leased.where("leased").count() == min(50, new.count()) and found.count() > 0
    merged = pipeline.deduplicate(found, NOW, pipeline.Settings())
    assert 0 < merged.count() <= found.count()
    assert pipeline.extract_batch(new, calls, reg, extract.keyword_extractor, pipeline.Settings(), NOW, 10.0) is None
    b = pipeline.publish(merged, NOW, pipeline.Settings()).orderBy("pos").collect()
    assert b[0].kind == "header" and [r.pos for r in b] == list(range(1, len(b) + 1))
    sent = []
    tables.post(pipeline.publish(merged, NOW, pipeline.Settings()), lambda x: sent.append(x) or "ok")
    assert len(sent) == 1 and tables.post(merged, sent.append, dry_run=True) == []


def test_bad_replies_are_rejected(spark):
    event = '{"action":"Launch","object_name_raw":"x","summary":"s","confidence":0.5}'
    df = spark.createDataFrame([("{bad",), ('{"is_event": true, "events": [%s]}' % event,), ('{"is_event": true, "events": [%s]}' % event.replace("0.5", "1.5"),), (None,)], "r string")
    assert [x.p is not None for x in df.select(extract.parsed(F.col("r")).alias("p")).collect()] == [False, True, False, False]


def test_schedule_is_idempotent(spark):
    cols = "task_id string, task_type string, payload string, priority int, run_at timestamp, status string, attempts int, max_attempts int, idempotency_key string, last_error string, locked_at timestamp, created_at timestamp, updated_at timestamp"
    t = pipeline.schedule(spark.createDataFrame([], cols), NOW, True)
    assert t.count() == 3 and pipeline.schedule(t, NOW, True).count() == 3
