"""Expressions over events: times, keys, titles, importance, validation, display."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed lists of the model.
CATEGORIES = ("product", "process", "marketing", "risk", "org", "unknown")
ACTIONS = ("Launch", "Deploy", "Migration", "Move", "Rollback", "Policy", "Campaign", "Webinar", "Incident", "RCA", "A/B Test", "Other")
STATUSES = ("planned", "confirmed", "started", "completed", "postponed", "canceled", "rolled_back", "updated")
CHANGE_TYPES = ("launch", "deploy", "migration", "rollback", "ab_test", "policy", "campaign", "incident", "rca", "other")
ENVIRONMENTS = ("prod", "staging", "dev", "multi", "unknown")
SEVERITIES = ("sev1", "sev2", "sev3", "info", "unknown")
TIME_SOURCES = ("explicit", "relative", "ts_fallback")
# Limits of an event.
MAX_TITLE, MAX_QUALIFIERS, MAX_LINKS, MAX_IMPACT, MAX_SUMMARY = 140, 2, 3, 3, 320
MIN_CONFIDENCE, MIN_IMPORTANCE = 0.6, 60
# Points of importance.
CATEGORY_BASE = {"product": 30, "risk": 35, "process": 20, "marketing": 15, "org": 25, "unknown": 10}
ENVIRONMENT_FACTOR = {"prod": 1.2, "multi": 1.15, "staging": 0.8, "dev": 0.6, "unknown": 1.0}
SEVERITY_POINTS = {"sev1": 20, "sev2": 15, "sev3": 10, "info": 5, "unknown": 0}
STATUS_POINTS = {"started": 10, "completed": 8, "rolled_back": 15, "canceled": 5, "postponed": 3, "planned": 0, "confirmed": 2, "updated": 5}
CRITICAL = ("authentication", "payment", "trading", "wallet", "database", "api-gateway")
# Display.
EMOJI = {"product": "🚀", "risk": "⚠️", "process": "⚙️", "marketing": "📢", "org": "👥", "unknown": "❓"}
CATEGORY_ORDER = {"product": 1, "risk": 2, "process": 3, "marketing": 4, "org": 5, "unknown": 6}
DATE_IN_SLOT = r"(?U)\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
EMOJI_IN_SLOT = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2700}-\x{27BF}]"
TOKEN_COSTS = {"gpt-5-nano": (0.075, 0.300), "gpt-4o-mini": (0.150, 0.600), "gpt-4o": (2.50, 10.00), "gpt-3.5-turbo": (0.50, 1.50)}
DEFAULT_MODEL = "gpt-5-nano"


def lookup(key: Column, values: dict, default) -> Column:
    """``values[key]``, else ``default``."""
    out = None
    for k, v in values.items():
        out = (F.when if out is None else out.when)(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def event_time() -> Column:
    """Actual before planned, start before end; null for an event without times."""
    return F.coalesce("actual_start", "actual_end", "planned_start", "planned_end")


def sort_time() -> Column:
    """The event's time, else when it was extracted."""
    return F.coalesce("actual_start", "actual_end", "planned_start", "planned_end", "extracted_at")


def iso(at: Column) -> Column:
    """As ISO text with offset; microseconds only where there are any."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(at, "SSSSSS")
    return F.concat(whole, F.when(part == "000000", F.lit("")).otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


def cluster_key() -> Column:
    """Groups the events of one initiative: action, object and first anchor."""
    name = F.coalesce(F.nullif(F.col("object_id"), F.lit("")), F.trim(F.lower("object_name_raw")))
    return F.sha1(F.concat(F.col("action"), F.lit("||"), name, F.lit("||"), F.coalesce(F.get("anchors", F.lit(0)), F.lit(""))))


def dedup_key() -> Column:
    """Tells instances apart: cluster, status, time and environment."""
    return F.sha1(F.concat(cluster_key(), F.lit("||"), F.col("status"), F.lit("||"), F.coalesce(iso(event_time()), F.lit("no-time")), F.lit("||"), F.col("environment")))


def title(style: str = "canonical") -> Column:
    """The title from an event's slots, shortened slot by slot if it is too long.

    ``style`` is canonical, object_first or severity_first; the last applies to
    risks only, others are canonical.
    """
    name, action = F.coalesce("object_name_raw", F.lit("")), F.col("action")
    head = F.concat(name, F.lit(": "), action) if style == "object_first" else F.concat(action, F.lit(": "), name)
    some = F.coalesce(F.size("qualifiers"), F.lit(0)) > 0
    quoted = lambda n: F.when(some, F.concat(F.lit(" — "), F.array_join(F.slice("qualifiers", 1, n), ", "))).otherwise("")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    stroke = F.when(given("stroke"), F.concat(F.lit(", "), F.col("stroke"))).otherwise("")
    anchor = F.when(given("anchor"), F.concat(F.lit(" ("), F.col("anchor"), F.lit(")"))).otherwise("")
    room = F.lit(MAX_TITLE - 4) - F.length(action)
    short = F.substr(name, F.lit(1), F.greatest(room, F.lit(0)))
    cut = F.concat(short, F.lit("...: "), action) if style == "object_first" else F.concat(action, F.lit(": "), short, F.lit("..."))
    out = None
    for t in (F.concat(head, quoted(2), stroke, anchor), F.concat(head, quoted(2), anchor), F.concat(head, quoted(1), anchor), F.concat(head, quoted(1)), head):
        out = (F.when if out is None else out.when)(F.length(t) <= MAX_TITLE, t)
    out = out.otherwise(cut)
    if style == "severity_first":
        label = F.when(given("severity") & (F.col("severity") != "unknown"), F.upper("severity")).otherwise("INCIDENT")
        bare = F.concat(label, F.lit(": "), F.lower(action), F.lit(" — "), name)
        full = F.concat(bare, stroke)
        out = F.when(F.col("category") == "risk", F.when(F.length(full) <= MAX_TITLE, full).otherwise(bare)).otherwise(out)
    return out


def heuristic(reactions: Column, mentions: Column) -> Column:
    """Points from 0 to 100 by category, scope, urgency, signals, anchors and critical systems."""
    areas = F.coalesce(F.size("impact_area"), F.lit(0))
    scope = F.when(areas >= MAX_IMPACT, 1.3).when(areas >= MAX_IMPACT - 1, 1.15).when(areas >= 1, 1.0).otherwise(0.9)
    base = lookup(F.col("category"), {k: float(v) for k, v in CATEGORY_BASE.items()}, 10.0)
    points = (base * (F.lit(1.0) * scope * lookup(F.col("environment"), ENVIRONMENT_FACTOR, 1.0))).cast("int")
    return F.least(
        points
        + F.coalesce(lookup(F.col("severity"), SEVERITY_POINTS, 0), F.lit(0))
        + lookup(F.col("status"), STATUS_POINTS, 0)
        + F.when(reactions > 0, F.least(reactions, F.lit(10))).otherwise(0)
        + F.when(mentions > 0, F.least(mentions * 3, F.lit(9))).otherwise(0)
        + F.least(F.coalesce(F.size("anchors"), F.lit(0)) * 5, F.lit(15))
        + F.when(F.exists(F.coalesce("impact_area", F.array().cast("array<string>")), lambda a: F.lower(a).isin(*CRITICAL)), 10).otherwise(0),
        F.lit(100),
    ).cast("int")


def importance(h: Column, now: datetime, given: Column | None = None, duplicate: Column | None = None) -> Column:
    """Importance from points ``h`` and a share ``given`` (0.5 if null), decayed past a week, less for duplicates."""
    s = F.coalesce(given, F.lit(0.5)) if given is not None else F.lit(0.5)
    first = F.rint(F.lit(0.6) * h + F.lit(0.4) * (s * F.lit(100.0)))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(event_time().cast("timestamp"))) / F.lit(1e6) / F.lit(86400.0)
    aged = F.when(event_time().isNotNull() & (age > 7.0), (first * F.pow(F.lit(0.9), age / F.lit(7.0))).cast("int")).otherwise(first.cast("int"))
    if duplicate is not None:
        aged = F.when(duplicate, F.greatest(aged - 20, F.lit(0))).otherwise(aged)
    return F.greatest(F.lit(0), F.least(aged, F.lit(100)))


def importance_label(value: Column) -> Column:
    return F.when(value >= 80, "critical").when(value >= 60, "high").when(value >= 40, "medium").otherwise("low")


# The messages of the checks below.
def _issues(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def title_issues() -> Column:
    """What is wrong with the slots of the title."""
    n = F.coalesce(F.size("qualifiers"), F.lit(0))
    slots = F.concat_ws(" ", F.coalesce("object_name_raw", F.lit("")), F.col("qualifiers"), F.coalesce("stroke", F.lit("")), F.coalesce("anchor", F.lit("")))
    return _issues(
        F.when(n > MAX_QUALIFIERS, F.concat(F.lit("Too many qualifiers: "), n.cast("string"), F.lit(f" (max {MAX_QUALIFIERS})"))),
        F.when(F.rlike(slots, F.lit("(?i)https?://")), "URLs not allowed in title slots"),
        F.when(F.rlike(slots, F.lit(DATE_IN_SLOT)), "Dates not allowed in title slots"),
        F.when(F.rlike(slots, F.lit(EMOJI_IN_SLOT)), "Emojis not allowed in title slots"),
    )


def structure_issues() -> Column:
    """Those of the slots, and a title that stays too long."""
    size = F.length(title())
    long = F.when(size > MAX_TITLE, F.concat(F.lit("Rendered title too long: "), size.cast("string"), F.lit(f" chars (max {MAX_TITLE})")))
    return F.concat(title_issues(), _issues(long))


def content_issues() -> Column:
    """What is wrong with the rest of an event; a warning starts with ``WARNING:``."""
    size = F.length("summary")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    needs = lambda status, column: F.when((F.col("status") == status) & F.col(column).isNull(), f"Status '{status}' requires {column} timestamp")
    links = F.filter(F.coalesce("links", F.array().cast("array<string>")), lambda u: ~(F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))))
    return F.concat(
        _issues(
            F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", "Summary is required").when(
                size > MAX_SUMMARY, F.concat(F.lit("Summary too long: "), size.cast("string"), F.lit(f" chars (max {MAX_SUMMARY})"))
            ),
            F.when(F.col("category") == "unknown", "WARNING: Category is unknown"),
            needs("completed", "actual_end"), needs("started", "actual_start"), needs("planned", "planned_start"), needs("confirmed", "planned_start"),
            F.when(count("links") > MAX_LINKS, F.concat(F.lit("Too many links: "), count("links").cast("string"), F.lit(f" (max {MAX_LINKS})"))),
        ),
        F.transform(links, lambda u: F.concat(F.lit("Invalid link format: "), u)),
        _issues(F.when(count("impact_area") > MAX_IMPACT, F.concat(F.lit("Too many impact areas: "), count("impact_area").cast("string"), F.lit(f" (max {MAX_IMPACT})")))),
    )


def all_issues() -> Column:
    return F.concat(title_issues(), content_issues())


def critical_issues(issues: Column | None = None) -> Column:
    return F.filter(all_issues() if issues is None else issues, lambda x: ~F.startswith(x, F.lit("WARNING:")))


def issue_summary() -> Column:
    """Critical, warnings and info, without their marks."""
    issues = all_issues()
    marked = lambda m: F.filter(issues, lambda x: F.startswith(x, F.lit(m)))
    return F.struct(
        F.filter(issues, lambda x: ~F.startswith(x, F.lit("WARNING:")) & ~F.startswith(x, F.lit("INFO:"))).alias("critical"),
        F.transform(marked("WARNING:"), lambda x: F.replace(x, F.lit("WARNING: "), F.lit(""))).alias("warnings"),
        F.transform(marked("INFO:"), lambda x: F.replace(x, F.lit("INFO: "), F.lit(""))).alias("info"),
    )


def quality_issues(min_confidence: float = MIN_CONFIDENCE) -> Column:
    """The summary, with low confidence as a warning and low importance as a remark."""
    s = issue_summary()
    low = _issues(F.when(F.col("confidence") < min_confidence, F.concat(F.lit("Low confidence: "), F.format_string("%.2f", "confidence"), F.lit(f" (threshold: {min_confidence})"))))
    minor = _issues(F.when(F.col("importance") < MIN_IMPORTANCE, F.concat(F.lit("Low importance: "), F.col("importance").cast("string"), F.lit(f" (threshold: {MIN_IMPORTANCE})"))))
    return F.struct(s["critical"].alias("errors"), F.concat(s["warnings"], low).alias("warnings"), F.concat(s["info"], minor).alias("info"))


def should_publish(min_importance: int = MIN_IMPORTANCE, min_confidence: float = MIN_CONFIDENCE) -> Column:
    return F.coalesce((F.col("confidence") >= min_confidence) & (F.col("importance") >= min_importance), F.lit(False)) & (F.size(critical_issues()) == 0)


def confidence_icon(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "✅").when(confidence >= 0.6, "⚠️").otherwise("❓")


def digest_text() -> Column:
    return F.concat(lookup(F.col("category"), EMOJI, "•"), F.lit(" "), title("severity_first"))


def category_order() -> Column:
    return lookup(F.col("category"), CATEGORY_ORDER, 99)


def cost(tokens_in: Column, tokens_out: Column, model: Column) -> Column:
    """Dollars of a call; an unknown model costs as the default one."""
    price = lambda i: lookup(model, {m: c[i] for m, c in TOKEN_COSTS.items()}, TOKEN_COSTS[DEFAULT_MODEL][i])
    return tokens_in / F.lit(1e6) * price(0) + tokens_out / F.lit(1e6) * price(1)


def one_of(value: Column, allowed: tuple[str, ...], default: str | None) -> Column:
    """``value`` if it is of the list, else ``default``."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default).cast("string"))
