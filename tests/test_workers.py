"""One message from its landing to the digest, through the queue."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.operators import candidates as C
from skein.operators import dedup, extract, objects
from skein.operators import state as S
from skein.plans import fixtures, pipeline, workers
from skein.sources import feeds
from skein.sources.tables import VersionedTable

NOW = datetime(2024, 1, 20, 12)


def stores(spark, at, channels):
    raw = lambda schema: spark.createDataFrame([], schema)
    empty = feeds.unified(feeds.slack_messages(raw(feeds.SLACK_RAW), NOW), feeds.telegram_messages(raw(feeds.TELEGRAM_RAW), NOW))
    built = C.select_candidates(C.score_messages(empty, channels))
    call = "id string, message_id string, prompt_hash string, model string, tokens_in int, tokens_out int, cached boolean, response_json string, ts timestamp"
    of = lambda name, schema, keys: VersionedTable(spark, f"file://{at}/{name}", schema, keys)
    return workers.Stores(
        of("messages", empty.schema, ["message_id"]), of("candidates", built.schema, ["message_id"]), of("calls", spark.createDataFrame([], call).schema, ["id"]),
        of("events", dedup.SCHEMA, ["dedup_key"]), of("tasks", workers.TASK, ["task_id"]),
    )


def started(spark, tmp_path, extractor=extract.keyword_extractor, **settings):
    landing = tmp_path / "landing"
    landing.mkdir()
    ts = f"{(NOW - timedelta(hours=2)).timestamp():.6f}"
    line = {"channel": "C_view", "ts": ts, "user": "u", "text": "Release v2 of the wallet ab-12 see https://a.example/1", "reply_count": 2}
    (landing / "a.json").write_text(json.dumps(line) + "\nnot json\n")
    channels = fixtures.channels(spark)
    s, sent = stores(spark, tmp_path, channels), []
    todo = workers.handlers(spark, s, channels, objects.registry(spark, {"pay.core": ["Payments"]}), extractor, lambda blocks: sent.append(blocks) or "sent", pipeline.Settings(min_confidence=0.5, **settings))
    row = [("ingest", json.dumps({"source": "slack", "path": f"file://{landing}"}), 10, NOW, 3, "ingest:1")]
    new = spark.createDataFrame(row, "task_type string, payload string, priority int, run_at timestamp, max_attempts int, idempotency_key string")
    s.tasks.write(S.enqueue(s.tasks.read(), new, NOW)[0])
    return s, todo, sent


def test_a_message_passes_through_the_chain(spark, tmp_path):
    s, todo, sent = started(spark, tmp_path)
    kind = "ingest"
    while kind:
        assert workers.work(s.tasks, kind, todo[kind], NOW) == {"done": 1, "failed": 0}
        kind = workers.CHAIN[kind]
    assert s.messages.read().count() == 1
    assert [(c.status, c.lease_attempts) for c in s.candidates.read().collect()] == [("llm_ok", 1)]
    events = s.events.read().collect()
    assert len(events) == 1 and events[0].action == "Launch" and events[0].source_channels == ["views"]
    assert sent and any("Launch" in b["text"] for b in sent[0] if b["text"])
    assert {r.idempotency_key: r.status for r in s.tasks.read().collect()} == {k: "done" for k in ("ingest:1", "extraction:ingest:1", "llm:extraction:ingest:1", "dedup:llm:extraction:ingest:1", "digest:dedup:llm:extraction:ingest:1")}
    # the same landing again: no new message, no new candidate, no second call
    todo["ingest"]({"source": "slack", "path": f"file://{tmp_path}/landing"}, NOW)
    todo["extraction"]({}, NOW)
    assert s.candidates.read().count() == 1 and s.calls.read().count() == 1
    assert todo["llm"]({"message_id": "nobody"}, NOW)["candidates_processed"] == 0


def test_failures_are_queued_again_and_noted(spark, tmp_path):
    def broken(batches):
        for b in batches:
            yield b[["prompt_hash"]].assign(response_json="{broken", tokens_in=1, tokens_out=1)

    s, todo, _ = started(spark, tmp_path, broken)
    assert workers.work(s.tasks, "ingest", lambda payload, now: 1 // 0, NOW)["failed"] == 1
    task = s.tasks.read().first()
    assert (task.status, task.attempts, task.last_error) == ("queued", 1, "integer division or modulo by zero") and task.run_at > NOW
    assert workers.work(s.tasks, "ingest", todo["ingest"], NOW) == {"done": 0, "failed": 0}
    later = NOW + timedelta(seconds=5)
    assert workers.work(s.tasks, "ingest", todo["ingest"], later)["done"] == 1
    assert workers.work(s.tasks, "extraction", todo["extraction"], later)["done"] == 1
    found = todo["llm"]({}, later)
    assert found["candidates_processed"] == 1 and found["events_extracted"] == 0 and found["errors"] == ["chunks without a valid reply: 0"]
    assert s.candidates.read().first().status == "llm_fail"


def test_a_spent_budget_fails_the_task(spark, tmp_path):
    s, todo, _ = started(spark, tmp_path, daily_budget=0.0)
    workers.work(s.tasks, "ingest", todo["ingest"], NOW)
    workers.work(s.tasks, "extraction", todo["extraction"], NOW)
    assert workers.work(s.tasks, "llm", todo["llm"], NOW) == {"done": 0, "failed": 1}
    assert "budget" in s.tasks.read().where("task_type = 'llm'").first().last_error
    assert C.call_allowed(5.0, 1.0, cached=True, first=True) and C.call_allowed(5.0, 1.0, False, first=False) and not C.call_allowed(5.0, 1.0, False, True)


def test_extractor_retries(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(extract, "RETRIES", {"rate": (0, 0, 0)})
    left = {"a": 2, "b": 9}

    def call(prompt):
        left[prompt] -= 1
        if left[prompt] >= 0:
            raise extract.CallFailed("rate")
        return "reply", 1, 2

    out = next(extract.retried(call)(iter([pd.DataFrame({"prompt_hash": ["1", "2"], "prompt": ["a", "b"]})])))
    assert out.response_json.tolist() == ["reply", None]
