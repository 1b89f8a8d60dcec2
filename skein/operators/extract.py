"""Events from candidates: prompts, replies, conversion, roll-ups.

The extractor itself is a parameter: a function over batches that adds a reply
to each prompt. ``keyword_extractor`` is a plain stand-in without a network.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import events as E
from skein.functions import python as P
from skein.functions import text as X
from skein.operators import objects

_S, _A = T.StringType(), T.ArrayType(T.StringType())
REPLY = T.StructType(
    [T.StructField("is_event", T.BooleanType()), T.StructField("overflow_note", _S), T.StructField("events", T.ArrayType(T.StructType(
        [T.StructField(n, _S) for n in ("action", "object_name_raw", "stroke", "anchor", "category", "status", "change_type", "environment", "severity", "planned_start", "planned_end",
                                        "actual_start", "actual_end", "time_source", "summary", "why_it_matters")]
        + [T.StructField(n, _A) for n in ("qualifiers", "links", "anchors", "impact_area", "impact_type")]
        + [T.StructField(n, T.DoubleType()) for n in ("time_confidence", "confidence")]
    )))]
)
MAX_EVENTS = 5

Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def prompts(candidates: DataFrame, model: str, version: str = "v1", system_hash: str = "") -> DataFrame:
    """A row for each chunk of a candidate's text: chunk_index, chunk_text, prompt_hash."""
    m = F.lit(model)
    size = X.character_budget(X.prompt_budget(m), m).cast("int")
    cut = candidates.select("*", F.posexplode(P.text_chunks(F.col("text_norm"), size)).alias("chunk_index", "chunk_text"))
    links = F.slice("links_norm", 1, 3)
    name = F.coalesce(F.col("features")["channel_name"], F.lit(""))
    return cut.withColumn(
        "prompt_hash", P.prompt_fingerprint(m, F.lit(version), F.lit(system_hash), F.col("chunk_index"), F.col("chunk_text"), links, E.iso(F.col("ts_dt")), name)
    ).withColumn("prompt", X.prompt(F.col("chunk_text"), links, F.col("ts_dt"), name))


def replies(asked: DataFrame, extractor: Extractor, cached: DataFrame) -> DataFrame:
    """Prompts with response_json and whether it came from ``cached`` (prompt_hash, response_json).

    Only prompts without a cached reply that parses reach the extractor, each
    distinct prompt once. Sides that grow with the candidates are never broadcast:
    their tables are so much smaller on disk that Spark would take them for small ones.
    """
    good = cached.where(F.from_json("response_json", REPLY)["is_event"].isNotNull()).dropDuplicates(["prompt_hash"])
    missing = asked.join(good.select("prompt_hash").hint("merge"), "prompt_hash", "left_anti").dropDuplicates(["prompt_hash"]).select("prompt_hash", "prompt")
    new = missing.mapInPandas(extractor, "prompt_hash string, response_json string, tokens_in int, tokens_out int")
    both = good.select("prompt_hash", "response_json", F.lit(0).alias("tokens_in"), F.lit(0).alias("tokens_out"), F.lit(True).alias("cached")).unionByName(new.withColumn("cached", F.lit(False)))
    return asked.join(both.hint("merge"), "prompt_hash")


def parsed(raw: Column) -> Column:
    """The reply, null if it isn't JSON of the agreed shape or one of its events breaks a bound."""
    r = F.from_json(raw, REPLY, {"mode": "PERMISSIVE"})
    fine = F.forall(
        F.coalesce(r["events"], F.array()),
        lambda e: F.coalesce(e["confidence"].between(0, 1) & (F.length(e["summary"]) <= E.MAX_SUMMARY) & e["object_name_raw"].isNotNull() & F.coalesce(e["time_confidence"].between(0, 1), F.lit(True)), F.lit(False)),
    )
    return F.when(r["is_event"].isNotNull() & fine & (F.size(F.coalesce(r["events"], F.array())) <= MAX_EVENTS), r)


def to_events(answered: DataFrame, registry: DataFrame, now: datetime, extracted_at: datetime | None = None) -> DataFrame:
    """Events of answered prompts: at most MAX_EVENTS a message, enums checked, keys and importance set, critical ones left out."""
    r = answered.withColumn("reply", parsed(F.col("response_json"))).where("reply is not null")
    per = r.groupBy("message_id", "source_id").agg(
        F.max(F.col("reply")["is_event"]).alias("is_event"), F.first("features").alias("features"), F.first("ts_dt").alias("ts_dt"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("reply")["events"].alias("events")))), lambda s: s["events"])).alias("events"),
    )
    each = per.where("is_event").select("message_id", "source_id", "features", F.posexplode(F.slice("events", 1, MAX_EVENTS)).alias("place", "e"))
    e = lambda c: F.col(f"e.{c}")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(e(c), none)
    name = F.col("features")["channel_name"]
    flat = each.select(
        F.sha1(F.concat_ws("|", "message_id", "place")).alias("event_id"), "message_id", "source_id", "features",
        F.when(F.coalesce(name, F.lit("")) != "", F.array(name)).otherwise(none).alias("source_channels"), F.lit(extracted_at or now).cast("timestamp").alias("extracted_at"),
        E.one_of(e("action"), E.ACTIONS, "Other").alias("action"), e("object_name_raw").alias("object_name_raw"), F.slice(some("qualifiers"), 1, E.MAX_QUALIFIERS).alias("qualifiers"),
        e("stroke").alias("stroke"), e("anchor").alias("anchor"), E.one_of(e("category"), E.CATEGORIES, "unknown").alias("category"), E.one_of(e("status"), E.STATUSES, "updated").alias("status"),
        E.one_of(e("change_type"), E.CHANGE_TYPES, "other").alias("change_type"), E.one_of(e("environment"), E.ENVIRONMENTS, "unknown").alias("environment"), E.one_of(e("severity"), E.SEVERITIES, None).alias("severity"),
        *[X.parse_time(e(c)).alias(c) for c in ("planned_start", "planned_end", "actual_start", "actual_end")], E.one_of(e("time_source"), E.TIME_SOURCES, "ts_fallback").alias("time_source"),
        F.coalesce(e("time_confidence"), F.lit(0.0)).alias("time_confidence"), e("summary").alias("summary"), e("why_it_matters").alias("why_it_matters"), F.slice(some("links"), 1, E.MAX_LINKS).alias("links"),
        some("anchors").alias("anchors"), F.slice(some("impact_area"), 1, E.MAX_IMPACT).alias("impact_area"), some("impact_type").alias("impact_type"), e("confidence").alias("confidence"),
    )
    named = objects.canonicalize(flat, registry)
    h = E.heuristic(F.col("features")["reaction_count"], F.col("features")["has_mention"].cast("int"))
    out = named.withColumn("importance", E.importance(h, now)).withColumn("cluster_key", E.cluster_key()).withColumn("dedup_key", E.dedup_key())
    return out.where(F.size(E.critical_issues()) == 0).drop("features")


def metrics(answered: DataFrame, events: DataFrame, model: str) -> DataFrame:
    """One row: events, calls, cache hits, cost."""
    calls = answered.agg(
        F.countDistinct("message_id").alias("candidates_processed"), F.count_if(~F.col("cached")).alias("llm_calls"), F.count_if("cached").alias("cache_hits"),
        F.coalesce(F.sum(E.cost(F.col("tokens_in"), F.col("tokens_out"), F.lit(model))), F.lit(0.0)).alias("total_cost_usd"),
    )
    return calls.join(F.broadcast(events.agg(F.count("*").alias("events_extracted"))), F.lit(True))  # one row each


def errors(answered: DataFrame) -> DataFrame:
    """(message_id, error): messages with a reply that is missing or isn't of the agreed shape."""
    bad = answered.where(parsed(F.col("response_json")).isNull())
    return bad.groupBy("message_id").agg(F.concat_ws(" ", F.lit("chunks without a valid reply:"), F.array_join(F.array_sort(F.collect_set(F.col("chunk_index").cast("string"))), ",")).alias("error"))


def finish(leased: DataFrame, answered: DataFrame) -> DataFrame:
    """The candidates of a lease with their outcome: ``llm_ok``, or ``llm_fail`` where a reply is missing or invalid."""
    failed = errors(answered).select("message_id", F.lit(True).alias("_failed"))
    taken = leased.where("leased").join(failed, "message_id", "left")
    status = F.when(F.coalesce("_failed", F.lit(False)), "llm_fail").otherwise("llm_ok")
    return taken.withColumn("status", status).withColumn("processing_started_at", F.lit(None).cast("timestamp")).drop("leased", "_failed")


def retried(call: Callable[[str], tuple[str, int, int]]) -> Extractor:
    """An extractor that sends each prompt to ``call`` (reply, tokens in and out), repeated as RETRIES says; a prompt that fails has no reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, prompt in zip(b["prompt_hash"], b["prompt"]):
                try:
                    rows.append((key, *retrying(lambda p=prompt: call(p))))
                except CallFailed:
                    rows.append((key, None, 0, 0))
            yield pd.DataFrame(rows, columns=["prompt_hash", "response_json", "tokens_in", "tokens_out"])

    return run


def keyword_extractor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in without a network: a prompt that speaks of a release or a failure becomes one event."""
    for b in batches:
        rows = []
        for key, prompt in zip(b["prompt_hash"], b["prompt"]):
            text = prompt.split("Message text:\n", 1)[-1].split("\nRelevant links:")[0].strip()
            at = re.search(r"timestamp: (\S+ \S+)", prompt)
            kind = re.search(r"release|launch|deploy|failed", text)
            links = re.findall(r"(?m)^- (http\S+)$", prompt)
            event = {
                "action": {"deploy": "Deploy", "failed": "Incident"}.get(kind[0] if kind else "", "Launch"), "object_name_raw": " ".join(text.split()[:4]), "qualifiers": [], "category": "product",
                "status": "started", "change_type": "launch", "environment": "prod", "actual_start": at[1].replace(" ", "T") if at else None, "time_source": "explicit", "time_confidence": 0.9,
                "summary": text[:200] or "-", "links": links, "anchors": re.findall(r"[a-z]{2,10}-\d+", text)[:3], "impact_area": [], "impact_type": [], "confidence": 0.8,
            }
            reply = json.dumps({"is_event": bool(kind), "overflow_note": None, "events": [event] if kind else []})
            rows.append((key, reply, len(prompt) // 4, len(reply) // 4))
        yield pd.DataFrame(rows, columns=["prompt_hash", "response_json", "tokens_in", "tokens_out"])


#: Seconds before the first, second and third repetition of a call, by what went wrong.
RETRIES = {"rate": (10, 20, 30), "timeout": (5, 10, 15), "validation": (2, 4, 6)}


class CallFailed(Exception):
    """A call to the extractor's service failed; ``kind`` is a key of RETRIES or something that isn't repeated."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


def retrying(call: Callable[[], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
    """``call``, repeated up to three times after failures of a known kind."""
    for i in range(4):
        try:
            return call()
        except CallFailed as e:
            if i == 3 or e.kind not in RETRIES:
                raise
            sleep(RETRIES[e.kind][i])
    raise AssertionError
