"""Steps whose memory must not grow with the input: what is broadcast, and how large a part is."""

from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from skein.operators import state as S
from skein.plans import registry

NOW = datetime(2024, 1, 20, 12)


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_answers_and_names_are_not_broadcast(spark, sf_dir, monkeypatch):
    from skein.plans import queries as Q

    seen = []
    real = Q.staged
    monkeypatch.setattr(Q, "staged", lambda df, name: seen.append((name, plan(df))) or real(df, name))
    events = registry.queries()["extracted_events"](spark, sf_dir)
    plans = dict(seen)
    assert {"prompts", "answered"} <= set(plans)  # no prompt is answered twice
    assert "BroadcastHashJoin" not in plans["answered"] and "SortMergeJoin" in plans["answered"]
    assert "LeftOuter, BuildRight" not in plan(events)


def test_asked_tasks_meet_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 10)
    cols = "task_id string, task_type string, payload string, priority int, run_at timestamp, status string, attempts int, max_attempts int, idempotency_key string, last_error string, locked_at timestamp, created_at timestamp, updated_at timestamp"
    tasks = spark.createDataFrame([(f"t{i}", "llm", "{}", 1, NOW, "queued", 0, 3, f"k{i}", None, None, NOW, NOW) for i in range(95)], cols)
    new = spark.createDataFrame([("llm", "{}", 1, NOW, 3, f"k{i}") for i in range(90, 100)], "task_type string, payload string, priority int, run_at timestamp, max_attempts int, idempotency_key string")
    every, asked = S.enqueue(tasks, new, NOW)
    assert asked.rdd.getNumPartitions() >= 10 and "Broadcast" not in plan(asked)
    assert {(r.idempotency_key, r.place) for r in asked.collect()} == {(f"k{i}", int(i < 95)) for i in range(90, 100)}
    assert every.count() == 100


def test_grid_of_queries_and_buckets_is_not_broadcast(spark):
    from skein.llm import retrieval

    vectors = spark.range(400).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
    found = retrieval.top_k(vectors, F.col("vec_id") % 20 == 0, k=5, bucket=32, block=8)
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    assert found.count() == 100


def test_memory_of_a_slice_of_texts():
    import tracemalloc

    from skein.llm import language_model as L
    from skein.llm._words import slices

    text = " ".join(f"w{i % 5000}" for i in range(4000))
    batch = pa.record_batch([pa.array([text] * (30_000_000 // len(text)))], ["text"])
    tracemalloc.start()
    for part in slices(batch, 0, L.TEXT):
        L.encode(part.column(0), {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20  # 24 MB of text at a time took 310 MB, 6 MB take 77


def test_softmaxes_of_long_texts_are_taken_of_many_rows(monkeypatch):
    import numpy as np

    from skein.llm import language_model as L

    net, calls, real = L.Network(3, 4, width=5, state=6), [], L._log_share
    net.flat[:] = np.random.default_rng(1).normal(0, 0.4, len(net.flat)).astype(np.float32)
    monkeypatch.setattr(L, "_log_share", lambda *a: calls.append(len(a[1])) or real(*a))
    L.log_probabilities(net, [np.arange(n) % 12 for n in (6000, 5, 40)])
    assert len(calls) <= 12 and min(calls) > 1500  # 752 calls when each window of 32 steps took its own


def test_words_and_gates_are_worked_out_once(monkeypatch):
    import numpy as np

    from skein.llm import language_model as L

    seen, sizes, shape, squash = [], [], L.shape_of, L._squash
    monkeypatch.setattr(L, "shape_of", lambda w: seen.append(w) or shape(w))
    monkeypatch.setattr(L, "_squash", lambda a: sizes.append(len(a)) or squash(a))
    words = ["plain", "é", "señor12345", "x1", "Ünicode-words", "elevenchars", "sixsix", "a\x00", "١"]
    texts = [" ".join(words) * 2, "", " é  plain "]
    got = L.encode(pa.array(texts), [b"\n", b"x1"])
    assert all(not w.isascii() for w in seen)  # each ASCII word was asked for by itself
    known = {L.END: 0, "x1": 1}
    assert got.ids.tolist() == [known.get(w, -1 - shape(w)) for t in texts for w in [*t.split(), L.END]]
    trainer = L.Trainer(L.Network(30, 40), end=0)
    trainer.step(np.array([[3, 5, 5, 7], [7, 3, 5, 3]]), np.zeros((2, 24), np.float32))
    assert sizes == [3]  # those of all 1,224 inputs


def test_logits_beyond_a_floats_bits_keep_their_shares():
    import numpy as np

    from skein.llm import language_model as L

    w, b = np.random.default_rng(2).normal(0, 1, (6, 9)).astype(np.float32), np.zeros(9, np.float32)
    states, at = np.random.default_rng(3).uniform(-1, 1, (50, 7)).astype(np.float32), np.arange(50) % 9
    states[:, -1] = 1
    (lines, wide), (far, beyond) = L._lines(w, b), L._lines(w, b + np.float32(128 * np.log(2)))
    assert not wide and beyond
    assert np.allclose(L._log_share(states @ lines, at, wide), L._log_share(states @ far, at, beyond), atol=1e-4)
    assert np.isfinite(L._log_share(states @ L._lines(w, b + np.float32(1e5))[0], at, True)).all()


def test_merging_moves_only_what_is_asked_for(spark, sf_dir):
    from skein.operators import dedup
    from skein.plans.queries import events

    e = events(spark, sf_dir)
    some = dedup.deduplicate(e, columns=("event_id", "dedup_key", "links"))
    assert some.columns == ["event_id", "links", "dedup_key"] and "summary" not in plan(some)
    full = dedup.deduplicate(e)
    assert full.columns == dedup.SCHEMA.names
    key = lambda rows: sorted((r.event_id, r.dedup_key, tuple(r.links)) for r in rows)
    assert key(some.collect()) == key(full.collect())


def test_pairs_are_not_broadcast(spark, sf_dir):
    from skein.operators import dedup
    from skein.plans.queries import events

    assert "BroadcastHashJoin" not in plan(dedup.matching_pairs(events(spark, sf_dir)))
