"""Parts of the queries' SQL for DuckDB: the derived views and common expressions."""

from __future__ import annotations

from skein.functions import text
from skein.plans.fixtures import CHANNELS_SQL, EVENTS, MESSAGES

_URL = text.URL.replace("'", "''")


def _normalized(t: str) -> str:
    for pattern, to in ((r"```[\s\S]*?```", " "), (r"`[^`]+`", " "), (f"(?i){_URL}", " "), (r"<@[A-Z0-9]+>", " "), (r"<#[A-Z0-9]+\|([^>]+)>", r"\1")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace(lower({t}), '\\s+', ' ', 'g'))"


def url(u: str) -> str:
    """A normalised URL."""
    full = f"CASE WHEN starts_with({u}, 'www.') THEN 'https://' || {u} ELSE {u} END"
    bare = f"split_part({full}, '#', 1)"
    base = f"split_part({bare}, '?', 1)"
    query = f"array_to_string(list_filter(string_split(regexp_replace({bare}, '^[^?]*\\??', ''), '&'), lambda p: NOT starts_with(p, 'utm_')), '&')"
    out = f"{base} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
    root = f"regexp_matches({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/$')"
    return f"CASE WHEN {root} THEN {out} ELSE regexp_replace({out}, '/+$', '') END"


_ALL = lambda p, g=0: f"regexp_extract_all(text, '{p}', {g})"
_PAIRS = lambda p: f"list_transform(list_zip({_ALL(p, 1)}, {_ALL(p, 2)}), lambda x: x[1] || '#' || x[2])"
_TAGGED = lambda tag, p, g: f"list_transform({_ALL(p, g)}, lambda x: '{tag}:' || x)"
LINKS = f"list_transform({_ALL('(?i)' + _URL)}, lambda u: split_part(regexp_replace(u, '[,.;:!?)]+$', ''), '|', 1))"


def _quoted(pattern: str) -> str:
    """A pattern inside SQL quotes; DuckDB's has no flag for Unicode classes."""
    return pattern.removeprefix("(?U)").replace("'", "''")


_FAMILIES = [
    _ALL(_quoted(text.JIRA), 1),
    _PAIRS(_quoted(text.GITHUB)),
    _PAIRS(_quoted(text.GITLAB)),
    _TAGGED("zoom", _quoted(text.ZOOM), 0),
    _TAGGED("meet", _quoted(text.MEET), 1),
    f"CASE WHEN regexp_matches(text, '{_quoted(text.TEAMS)}') THEN ['teams:meeting'] ELSE [] END",
    _TAGGED("confluence", _quoted(text.CONFLUENCE), 1),
    _TAGGED("notion", _quoted(text.NOTION), 1),
    _TAGGED("gdoc", _quoted(text.GDOC), 1),
]
FAMILIES = f"list_concat({', '.join(_FAMILIES)})"
ANCHORS = f"list_sort(list_distinct({FAMILIES}))"

M = f"m AS ({MESSAGES})"
N = (
    f"n AS (SELECT *, {_normalized('text')} AS text_norm, {LINKS} AS links_raw, list_transform({LINKS}, lambda u: {url('u')}) AS links_norm, {ANCHORS} AS anchors FROM m)"
)
C = f"c AS (SELECT * FROM ({CHANNELS_SQL}) WHERE ord < 6)"


def _times(t: str, k: str) -> str:
    return f"(length({t}) - length(replace({t}, '{k}', ''))) // {len(k)}"


_LOW = "CASE WHEN source_id = 'slack' THEN lower(text || ' ') ELSE lower(text_norm) END"
_SEEN = "CASE WHEN source_id = 'slack' THEN text ELSE text_norm END"
F = (
    "f AS (SELECT n.*, c.* EXCLUDE (source_id, channel), "
    + " + ".join(_times(_LOW, k) for k in ("release", "deploy", "launch"))
    + f""" AS keyword_count, regexp_matches({_SEEN}, '<!channel>|<!here>|@channel|@here') AS has_mention,
 CASE WHEN source_id <> 'slack' AND is_reply THEN greatest(reply_count, 1) ELSE reply_count END AS replies, reactions_count AS reaction_count, len(anchors) AS anchor_count, len(links_norm) AS link_count
 FROM n JOIN c USING (source_id, channel))"""
)
S = """s AS (SELECT *, 0.0::DOUBLE + CASE WHEN keyword_count > 0 THEN keyword_weight * keyword_count ELSE 0 END + CASE WHEN has_mention THEN mention_weight ELSE 0 END
 + CASE WHEN replies >= 1 THEN reply_weight ELSE 0 END + CASE WHEN reaction_count >= 2 THEN reaction_weight ELSE 0 END + least(anchor_count * anchor_weight, 12.0) + least(link_count * link_weight, 6.0)
 + CASE WHEN has_file THEN file_weight ELSE 0 END + CASE WHEN is_bot AND coalesce(bot_id, '') <> 'B1' THEN bot_penalty ELSE 0 END AS score FROM f)"""
#: Candidates: status varies by message so that filters find something.
K = "k AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'llm_ok' ELSE 'new' END AS status FROM s WHERE score >= threshold_score)"
SCORED = f"WITH {M}, {N}, {C}, {F}, {S}, {K}"

E = f"""e AS (SELECT *, [source_channel] AS source_channels, [top_anchor] AS anchors, ['wallet', 'search', 'billing', 'ops'][1:n_areas] AS impact_area,
 ['alpha', 'beta', 'gamma'][1:n_qualifiers] AS qualifiers, ['https://l/1/' || top_anchor, 'https://l/2/' || top_anchor, 'https://l/3/' || top_anchor, 'ftp://l/4/' || top_anchor][1:n_links] AS links FROM ({EVENTS}))"""
EVENT_TIME = "coalesce(actual_start, actual_end, planned_start, planned_end)"
SORT_TIME = "coalesce(actual_start, actual_end, planned_start, planned_end, extracted_at)"
CLUSTER = "sha1(action || '||' || coalesce(object_id, trim(lower(object_name_raw))) || '||' || top_anchor)"
DEDUP = f"sha1({CLUSTER} || '||' || status || '||' || coalesce(strftime({EVENT_TIME}, '%Y-%m-%dT%H:%M:%S') || '+00:00', 'no-time') || '||' || environment)"
TITLE = """action || ': ' || object_name_raw || CASE WHEN n_qualifiers > 0 THEN ' — ' || array_to_string(qualifiers[1:2], ', ') ELSE '' END
 || CASE WHEN stroke IS NOT NULL THEN ', ' || stroke ELSE '' END || CASE WHEN anchor IS NOT NULL THEN ' (' || anchor || ')' ELSE '' END"""
RISK_TITLE = """CASE WHEN severity IS NOT NULL AND severity <> 'unknown' THEN upper(severity) ELSE 'INCIDENT' END || ': ' || lower(action) || ' — ' || object_name_raw
 || CASE WHEN stroke IS NOT NULL THEN ', ' || stroke ELSE '' END"""
HEURISTIC = """least(100, CAST(trunc(CAST(CASE category WHEN 'product' THEN 30 WHEN 'risk' THEN 35 WHEN 'process' THEN 20 WHEN 'marketing' THEN 15 WHEN 'org' THEN 25 ELSE 10 END AS DOUBLE)
  * (1.0::DOUBLE * CAST(CASE WHEN n_areas >= 3 THEN 1.3 WHEN n_areas >= 2 THEN 1.15 WHEN n_areas >= 1 THEN 1.0 ELSE 0.9 END AS DOUBLE)
  * CAST(CASE environment WHEN 'prod' THEN 1.2 WHEN 'multi' THEN 1.15 WHEN 'staging' THEN 0.8 WHEN 'dev' THEN 0.6 ELSE 1.0 END AS DOUBLE))) AS INTEGER)
 + CASE severity WHEN 'sev1' THEN 20 WHEN 'sev2' THEN 15 WHEN 'sev3' THEN 10 WHEN 'info' THEN 5 ELSE 0 END
 + CASE status WHEN 'started' THEN 10 WHEN 'completed' THEN 8 WHEN 'planned' THEN 0 ELSE 5 END
 + least(CAST(k % 13 AS INTEGER), 10) + least(CAST(k % 5 AS INTEGER) * 3, 9) + 5 + CASE WHEN n_areas > 0 THEN 10 ELSE 0 END)"""
SLOTS = "object_name_raw || CASE WHEN n_qualifiers > 0 THEN ' ' || array_to_string(qualifiers, ' ') ELSE '' END || ' ' || coalesce(stroke, '') || ' ' || coalesce(anchor, '')"
ISSUES = f"""list_filter([
 CASE WHEN n_qualifiers > 2 THEN 'Too many qualifiers: ' || n_qualifiers || ' (max 2)' END,
 CASE WHEN regexp_matches({SLOTS}, '(?i)https?://') THEN 'URLs not allowed in title slots' END,
 CASE WHEN regexp_matches({SLOTS}, '\\b\\d{{1,2}}[./]\\d{{1,2}}[./]\\d{{2,4}}\\b|\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') THEN 'Dates not allowed in title slots' END,
 CASE WHEN trim(summary) = '' THEN 'Summary is required' END,
 CASE WHEN category = 'unknown' THEN 'WARNING: Category is unknown' END,
 CASE WHEN status = 'completed' AND actual_end IS NULL THEN 'Status ''completed'' requires actual_end timestamp' END,
 CASE WHEN status = 'started' AND actual_start IS NULL THEN 'Status ''started'' requires actual_start timestamp' END,
 CASE WHEN status = 'planned' AND planned_start IS NULL THEN 'Status ''planned'' requires planned_start timestamp' END,
 CASE WHEN n_links > 3 THEN 'Too many links: ' || n_links || ' (max 3)' END,
 CASE WHEN n_links > 3 THEN 'Invalid link format: ftp://l/4/' || top_anchor END], lambda x: x IS NOT NULL)"""
CRITICAL = f"list_filter({ISSUES}, lambda x: NOT starts_with(x, 'WARNING:'))"
CATEGORY_ORDER = "CASE category WHEN 'product' THEN 1 WHEN 'risk' THEN 2 WHEN 'process' THEN 3 WHEN 'marketing' THEN 4 WHEN 'org' THEN 5 WHEN 'unknown' THEN 6 ELSE 99 END"
EMOJI = "CASE category WHEN 'product' THEN '🚀' WHEN 'risk' THEN '⚠️' WHEN 'process' THEN '⚙️' WHEN 'marketing' THEN '📢' WHEN 'org' THEN '👥' WHEN 'unknown' THEN '❓' ELSE '•' END"
EVENTS_SQL = f"WITH {E}"
