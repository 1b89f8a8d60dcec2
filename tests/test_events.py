"""Scores, titles, importance and validation on hand-made rows; the merge rule on chains and random input."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.functions import events as E
from skein.operators import dedup, objects
from skein.operators.dedup import SCHEMA, fold

T0 = datetime(2025, 1, 1)


def event(i, **k):
    e = dict(
        event_id=f"e{i:03d}", message_id=f"m{i}", source_channels=["c"], extracted_at=T0 + timedelta(minutes=i), source_id="slack", action="Launch", object_id=None, object_name_raw="New wallet feature",
        qualifiers=[], stroke=None, anchor=None, category="product", status="started", change_type="launch", environment="prod", severity=None, planned_start=None, planned_end=None,
        actual_start=T0 + timedelta(hours=i), actual_end=None, time_source="explicit", time_confidence=0.5, summary="s", why_it_matters=None, links=[], anchors=["A-1"], impact_area=[], impact_type=[],
        confidence=0.7, importance=50, cluster_key="", dedup_key="",
    )
    e |= k
    e["dedup_key"] = k.get("dedup_key") or dedup._key(e)
    return e


def table(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in SCHEMA) for r in rows], SCHEMA)


def test_titles(spark):
    rows = [
        event(0, qualifiers=["alpha", "beta", "gamma"], stroke="Wallet team", anchor="INV-1", category="risk", severity="sev1"),
        event(1, object_name_raw="x" * 130, stroke="s" * 30, qualifiers=["q", "r"], anchor="INV-2"),
        event(2, object_name_raw="y" * 300),
    ]
    got = table(spark, rows).select("event_id", *[E.title(s).alias(s) for s in ("canonical", "object_first", "severity_first")]).orderBy("event_id").collect()
    assert got[0].canonical == "Launch: New wallet feature — alpha, beta, Wallet team (INV-1)"
    assert got[0].object_first == "New wallet feature: Launch — alpha, beta, Wallet team (INV-1)"
    assert got[0].severity_first == "SEV1: launch — New wallet feature, Wallet team"
    assert got[1].canonical == "Launch: " + "x" * 130
    assert got[2].canonical == "Launch: " + "y" * 130 + "..." and len(got[2].canonical) == 141
    for r, g in zip(rows, got):
        assert dedup._title(r) == g.canonical


def test_keys_agree(spark):
    rows = [event(0), event(1, actual_start=None, anchors=[]), event(2, actual_start=datetime(2025, 1, 1, 2, 3, 4, 5)), event(3, object_id="a.b")]
    got = {r.event_id: r.k for r in table(spark, rows).select("event_id", E.dedup_key().alias("k")).collect()}
    assert got == {r["event_id"]: r["dedup_key"] for r in rows}


def test_importance(spark):
    now = T0 + timedelta(days=21)
    rows = [event(0, impact_area=["Wallet", "b", "c"], severity="sev1", actual_start=T0), event(1, category="none", environment="?", anchors=[], actual_start=None)]
    h = E.heuristic(F.lit(12), F.lit(4))
    got = table(spark, rows).select("event_id", h.alias("h"), E.importance(h, now).alias("i"), E.importance(h, now, F.lit(1.0), F.lit(True)).alias("d")).orderBy("event_id").collect()
    assert got[0].h == min(100, int(30 * (1.3 * 1.2)) + 20 + 10 + 10 + 9 + 5 + 10)
    assert got[0].i == int(round(0.6 * got[0].h + 20) * 0.9**3)
    assert got[1].h == int(10 * 0.9) + 10 + 10 + 9
    assert got[1].i == round(0.6 * got[1].h + 20) and got[1].d == round(0.6 * got[1].h + 40) - 20


def test_validation(spark):
    rows = [event(0), event(1, status="completed", summary=" ", links=["ftp://x", "http://a", "https://b", "https://c"], category="unknown", object_name_raw="on 2025-01-02 😀 HTTPS://x")]
    a, b = (r.i for r in table(spark, rows).orderBy("event_id").select(E.all_issues().alias("i")).collect())
    assert a == []
    assert b == [
        "URLs not allowed in title slots", "Dates not allowed in title slots", "Emojis not allowed in title slots", "Summary is required", "WARNING: Category is unknown",
        "Status 'completed' requires actual_end timestamp", "Too many links: 4 (max 3)", "Invalid link format: ftp://x",
    ]


def ids(events):
    return [e["event_id"] for e in events]


def test_fold_rules():
    assert ids(fold([event(0), event(1)])) == ["e000"]
    assert len(fold([event(0, message_id="m"), event(1, message_id="m")])) == 2
    assert len(fold([event(0), event(1, source_id="telegram")])) == 2
    assert len(fold([event(0), event(48)])) == 1 and len(fold([event(0), event(48, actual_start=T0 + timedelta(hours=48, seconds=1))])) == 2
    assert len(fold([event(0), event(99, actual_start=None)])) == 1
    assert len(fold([event(0, object_name_raw="New wallet feature released"), event(1, object_name_raw="Something else altogether")])) == 2
    chain = fold([event(0, anchors=["A"]), event(1, anchors=["A", "B"]), event(2, anchors=["B"])])
    assert ids(chain) == ["e000"] and chain[0]["anchors"] == ["A", "B"]
    merged = fold([event(0, links=["a", "b"], confidence=0.5), event(1, links=["c", "d"], confidence=0.9, stroke="x")])[0]
    assert merged["links"] == ["a", "b", "c"] and merged["confidence"] == 0.9 and merged["stroke"] == "x" and merged["dedup_key"] == dedup._key(merged)
    assert fold([]) == []


def test_blocked_fold_equals_fold(spark):
    rnd = random.Random(5)
    names = ["New wallet feature", "New wallet features", "Data centre move", "Data center move"]
    rows = [
        event(i, anchors=rnd.sample(["A", "B", "C", "D", "E", "F", "G", "H"], rnd.randint(0, 2)), links=rnd.sample(["l1", "l2", "l3", "l4"], rnd.randint(0, 1)), object_name_raw=rnd.choice(names),
              message_id=f"m{rnd.randint(0, 60)}", source_id=rnd.choice(["slack", "telegram"]), actual_start=rnd.choice([None, T0 + timedelta(hours=rnd.randint(0, 300))]), status=rnd.choice(["started", "planned"]))
        for i in range(120)
    ]
    order = lambda e: (next((e[c] for c in ("actual_start", "actual_end", "planned_start", "planned_end") if e[c]), e["extracted_at"]), e["extracted_at"], e["event_id"])
    want = {(e["event_id"], e["dedup_key"], tuple(e["anchors"]), tuple(e["links"])) for e in fold(sorted(rows, key=order))}
    got = {(r.event_id, r.dedup_key, tuple(r.anchors), tuple(r.links)) for r in dedup.deduplicate(table(spark, rows)).collect()}
    assert got == want and len(want) < 120


def test_fold_of_components_that_are_cut_by_time(spark):
    """Over months, with times of all kinds, so that merged times move on; most identifiers have gaps."""
    rnd = random.Random(8)
    start = lambda: rnd.choice([0, 30, 60, 90, 120, 150, 180, 700, 740, 780, 1500, 2000, 2040]) + rnd.randint(0, 10)
    rows = []
    for i in range(150):
        base = start()
        times = {c: T0 + timedelta(hours=base + rnd.randint(-60, 60)) for c in rnd.sample(["actual_start", "actual_end", "planned_start", "planned_end"], rnd.randint(1, 2))}
        rows.append(event(i, anchors=rnd.sample("ABCDEF", rnd.randint(1, 2)), object_name_raw=rnd.choice(["New wallet feature", "New wallet features"]), message_id=f"m{i}", **({"actual_start": None} | times)))
    order = lambda e: (next((e[c] for c in ("actual_start", "actual_end", "planned_start", "planned_end") if e[c]), e["extracted_at"]), e["extracted_at"], e["event_id"])
    want = {(e["event_id"], e["dedup_key"], tuple(e["anchors"])) for e in fold(sorted(rows, key=order))}
    events = table(spark, rows)
    assert {(r.event_id, r.dedup_key, tuple(r.anchors)) for r in dedup.deduplicate(events).collect()} == want
    assert dedup.component_sizes(events).count() > 1


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [
        event(i, anchors=rnd.sample("ABCD", rnd.randint(0, 2)), object_name_raw=rnd.choice(["New wallet feature", "New wallet features", "Other"]), message_id=f"m{i % 30}", actual_start=rnd.choice([None, T0 + timedelta(hours=rnd.randint(0, 200))]))
        for i in range(60)
    ]
    want = {(a["event_id"], b["event_id"]) for i, a in enumerate(rows) for b in rows[i + 1 :] if dedup._matches(a, b, 48, 0.8)}
    assert {(r.left_id, r.right_id) for r in dedup.matching_pairs(table(spark, rows)).collect()} == want


def test_empty(spark):
    assert dedup.deduplicate(table(spark, [])).count() == 0


def test_objects(spark):
    reg = objects.registry(spark, {"wallet.stocks": ["Stocks & ETFs", "Stock trading"], "data.clickhouse": ["CH cluster"], "other": ["stock trading"]})
    names = spark.createDataFrame([("Stocks & ETFs ",), ("Stocks and ETFs",), ("ch clusters",), ("Stock trading",), ("Unknown System",), (None,), ("",)], "object_name_raw string")
    got = {r.object_name_raw: r.object_id for r in objects.canonicalize(names, reg).collect()}
    assert got == {"Stocks & ETFs ": "wallet.stocks", "Stocks and ETFs": None, "ch clusters": "data.clickhouse", "Stock trading": "other", "Unknown System": None, None: None, "": None}
    assert {r.synonym_norm for r in objects.synonyms_of(reg, "wallet.stocks").collect()} == {"stocks & etfs"}
    assert objects.object_ids(reg).count() == 3


def test_similar_names_are_all_met(spark):
    """Names that differ from a synonym by as much as is allowed, anywhere, against the plain comparison of all."""
    from skein.functions.python import ratio

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh ") for _ in range(n)).strip() or "x" for n in (1, 3, 4, 5, 9, 10, 14, 19, 20, 21, 33, 47)]
    names = set()
    for w in words:
        for _ in range(60):
            t = list(w)
            for _ in range(rnd.randint(0, len(w) // 4 + 1)):
                i = rnd.randrange(len(t) + 1)
                t[i : i + rnd.randint(0, 1)] = rnd.choice(["", "z", "a"])
            names.add("".join(t).strip())
    reg = objects.registry(spark, {f"o{i}": [w] for i, w in enumerate(words)})
    got = {r.object_name_raw: r.object_id for r in objects.canonicalize(spark.createDataFrame([(n,) for n in names], "object_name_raw string"), reg).collect()}
    for n in names:
        score = [(2.0 if n == w else ratio(n, w), -i) for i, w in enumerate(words)]
        best = max(score)
        assert got[n] == (f"o{-best[1]}" if n and best[0] >= 0.9 else None)
    assert sum(v is not None for v in got.values()) > 100


@pytest.mark.parametrize("spent, want", [(10.0, "stop"), (8.5, "best"), (8.0, "all"), (0.0, "all")])
def test_gate(spent, want):
    from skein.operators.candidates import gate

    assert gate(spent, 10.0) == want
