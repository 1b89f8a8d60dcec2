"""Text functions over columns: cleaning, links, identifiers, token estimates.

All are built-in expressions, so they stay in generated code. Patterns use
``(?U)`` where white space, digits and word characters are Unicode ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of links, identifiers and mentions.
URL = r"https?://[^\s<>\"']+|www\.[^\s<>\"']+"
JIRA = r"(?U)\b([A-Z]{2,10}-\d+)\b"
GITHUB = r"github\.com/([a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+)(?:/issues/|/pull/|#)(\d+)"
GITLAB = r"gitlab\.com/([a-zA-Z0-9_/-]+)(?:/issues/|/merge_requests/|-/issues/|-/merge_requests/)(\d+)"
ZOOM = r"zoom\.us/[^\s<>\"']+"
MEET = r"meet\.google\.com/([a-z]{3}-[a-z]{4}-[a-z]{3})"
TEAMS = r"teams\.microsoft\.com/[^\s<>\"']+"
CONFLUENCE = r"confluence\.[a-z0-9.-]+/(?:pages/viewpage\.action\?pageId=|display/[^/]+/)([0-9]+)"
NOTION = r"notion\.so/[^\s<>\"']*-([a-f0-9]{32})"
GDOC = r"docs\.google\.com/[^\s<>\"']+/d/([a-zA-Z0-9_-]{25,})"
MENTION = r"<!channel>|<!here>|@channel|@here"

# Prompt budgets in tokens and characters per token, by model.
PROMPT_BUDGETS = {"gpt-5-nano": 3500, "gpt-4o-mini": 6000}
CHARS_PER_TOKEN = {"gpt-5-nano": 3, "gpt-4o-mini": 4}
DEFAULT_BUDGET, DEFAULT_CHARS = 3000, 4


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def normalize(text: Column) -> Column:
    """Lower-cased text without code, links and markup of mentions, white space folded. Null stays null."""
    for pattern, to in (
        (r"```[\s\S]*?```", " "), (r"`[^`]+`", " "), (f"(?i){URL}", " "), (r"<@[A-Z0-9]+>", " "), (r"<#[A-Z0-9]+\|([^>]+)>", "$1"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def combine(text: Column, blocks: Column) -> Column:
    """The text and that of its blocks, without saying the same twice."""
    text, blocks = F.coalesce(text, F.lit("")), F.coalesce(blocks, F.lit(""))
    return (
        F.when((blocks == "") | (blocks == text), text)
        .when((text != "") & F.contains(blocks, text), blocks)
        .otherwise(F.regexp_replace(F.concat(text, F.lit(" "), blocks), r"(?U)^\s+|\s+$", ""))
    )


def urls(text: Column) -> Column:
    """Links as they stand: final punctuation and a label after a bar cut off."""
    found = F.transform(_all(text, f"(?i){URL}"), lambda u: F.substring_index(F.regexp_replace(u, r"[,.;:!?)]+$", ""), "|", 1))
    return found


def normalize_url(url: Column) -> Column:
    """With a scheme, without ``utm_`` parameters, fragment and a final slash (a root's slash stays)."""
    full = F.when(F.startswith(url, F.lit("www.")), F.concat(F.lit("https://"), url)).otherwise(url)
    bare = F.substring_index(full, "#", 1)
    base = F.substring_index(bare, "?", 1)
    query = F.when(F.contains(bare, F.lit("?")), F.expr("1")).isNotNull()
    kept = F.array_join(F.filter(F.split(F.regexp_replace(bare, r"^[^?]*\??", ""), "&"), lambda p: ~F.startswith(p, F.lit("utm_"))), "&")
    out = F.when(query & (kept != ""), F.concat(base, F.lit("?"), kept)).otherwise(base)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$", 1)
    # the scheme is lower-cased, the host isn't
    out = F.concat(F.lower(F.regexp_extract(out, r"^([A-Za-z][A-Za-z0-9+.-]*:)?", 0)), F.regexp_replace(out, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""))
    return F.when(F.endswith(out, F.lit("/")) & (path != "/"), F.regexp_replace(out, r"/+$", "")).otherwise(out)


def normalize_urls(found: Column) -> Column:
    return F.transform(found, normalize_url)


def anchors(text: Column) -> Column:
    """Identifiers in a text, by family, each once in the order of first sight."""

    def pairs(pattern: str) -> Column:
        return F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda repo, n: F.concat(repo, F.lit("#"), n))

    def tagged(tag: str, pattern: str, group: int) -> Column:
        return F.transform(_all(text, pattern, group), lambda x: F.concat(F.lit(tag), x))

    return F.array_distinct(
        F.concat(
            _all(text, JIRA, 1), pairs(GITHUB), pairs(GITLAB), tagged("zoom:", ZOOM, 0), tagged("meet:", MEET, 1),
            F.when(F.rlike(text, F.lit(TEAMS)), F.array(F.lit("teams:meeting"))).otherwise(F.array().cast("array<string>")),
            tagged("confluence:", CONFLUENCE, 1), tagged("notion:", NOTION, 1), tagged("gdoc:", GDOC, 1),
        )
    )


def mentions_channel(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(MENTION)), F.lit(False))


def _by_model(model: Column, values: dict[str, int], default: int) -> Column:
    out = None
    for name, value in values.items():
        out = (F.when if out is None else out.when)(model == name, value)
    return out.otherwise(default)


def token_estimate(text: Column, model: Column) -> Column:
    """Tokens by characters; none for an empty text, else one at least."""
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(size / _by_model(model, CHARS_PER_TOKEN, DEFAULT_CHARS)))).cast("int")


def prompt_budget(model: Column) -> Column:
    """Tokens that a prompt may take."""
    return _by_model(model, PROMPT_BUDGETS, DEFAULT_BUDGET)


def character_budget(tokens: Column, model: Column) -> Column:
    return F.greatest(F.lit(1), tokens * _by_model(model, CHARS_PER_TOKEN, DEFAULT_CHARS))


def message_id(channel: Column, ts: Column) -> Column:
    return F.sha1(F.concat(channel, F.lit("|"), ts))


def lenient_number(raw: Column) -> Column:
    """A number, or zero for anything that isn't one."""
    return F.coalesce(raw.try_cast("double"), F.lit(0.0))


def post_url(channel: Column, number: Column) -> Column:
    """Address of a message of a channel with a public name."""
    return F.when(F.startswith(channel, F.lit("@")), F.concat(F.lit("https://t.me/"), F.substr(channel, F.lit(2)), F.lit("/"), number))


def span(text: Column, offset: Column, length: Column) -> Column:
    return F.substr(text, offset + 1, length)


def preview(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substr(text, F.lit(1), F.lit(size)), F.lit("..."))).otherwise(text)


def local_time(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "dd.MM.yyyy HH:mm")


def parse_time(raw: Column) -> Column:
    """An ISO time, of UTC if it names no zone; null for anything else."""
    return F.when(F.rlike(raw, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.regexp_replace(raw, "Z$", "+00:00").try_cast("timestamp"))


# The phrases of the prompt.
def prompt(text: Column, links: Column, at: Column, channel: Column) -> Column:
    """The prompt for a message: channel, time, text and up to three links."""
    listed = F.array_join(F.transform(F.slice(links, 1, 3), lambda u: F.concat(F.lit("- "), u)), "\n")
    return F.concat_ws(
        "\n",
        F.when(F.coalesce(channel, F.lit("")) != "", F.concat(F.lit("Channel: #"), channel)),
        F.concat(F.lit("Message timestamp: "), F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'")),
        F.concat(F.lit("\nMessage text:\n"), F.coalesce(text, F.lit(""))),
        F.when(F.size(links) > 0, F.concat(F.lit("\nRelevant links:\n"), listed)),
    )
