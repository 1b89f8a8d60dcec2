"""Literal vectors of the text functions."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import python as P
from skein.functions import text as X


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Check out https://example.com for details!", "check out for details!"),
        ("a ```code\nmore``` b `x y` c", "a b c"),
        ("<@U12AB> hi <#C1|General> <!channel>", "hi general <!channel>"),
        ("A  B\n\tC ", "a b c"),
        ("see WWW.Example.com now", "see now"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://example.com/page?utm_source=x&id=1#section", "https://example.com/page?id=1"),
        ("https://e.com/", "https://e.com/"),
        ("https://e.com/a/", "https://e.com/a"),
        ("https://e.com/a/?utm_medium=b", "https://e.com/a"),
        ("www.e.com/x", "https://www.e.com/x"),
        ("HTTPS://E.com/A", "https://E.com/A"),
        ("https://e.com/?a=1", "https://e.com/?a=1"),
        ("https://e.com", "https://e.com"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, X.normalize_url(F.col("u")), u=url) == want


def test_urls(spark):
    assert one(spark, X.urls(F.col("t")), t="(see https://a.example/x), HTTP://b.example/y|label> www.c.example!") == ["https://a.example/x", "HTTP://b.example/y", "www.c.example"]
    assert one(spark, X.urls(F.col("t")), t=None) == []


def test_anchors(spark):
    t = (
        "PROJ-12 gitlab.com/group/proj/-/issues/10 github.com/org/repo/pull/5 PROJ-12 zoom.us/j/9 meet.google.com/abc-defg-hij teams.microsoft.com/l/1 teams.microsoft.com/l/2 "
        "confluence.x.io/pages/viewpage.action?pageId=77 notion.so/Page-0123456789abcdef0123456789abcdef docs.google.com/document/d/ABCDEFGHIJKLMNOPQRSTUVWXYZ A-1 xPROJ-3"
    )
    assert one(spark, X.anchors(F.col("t")), t=t) == [
        "PROJ-12", "org/repo#5", "group/proj/-#10", "zoom:zoom.us/j/9", "meet:abc-defg-hij", "teams:meeting", "confluence:77",
        "notion:0123456789abcdef0123456789abcdef", "gdoc:ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    ]


@pytest.mark.parametrize("t, b, want", [("Hello", "Hello", "Hello"), ("Hello", "Hello Extra", "Hello Extra"), ("a", "b", "a b"), ("", "b", "b"), ("a", None, "a"), (None, None, "")])
def test_combine(spark, t, b, want):
    assert one(spark, X.combine(F.col("t"), F.col("b")), t=t, b=b) == want


@pytest.mark.parametrize(
    "raw, want",
    [("2025-10-15T08:00:00Z", datetime(2025, 10, 15, 8)), ("2025-10-15", datetime(2025, 10, 15)), ("2025-10-15T08:00:00+02:00", datetime(2025, 10, 15, 6)), ("2025", None), ("soon", None), (None, None), ("2025-13-45", None)],
)
def test_parse_time(spark, raw, want):
    assert one(spark, X.parse_time(F.col("t")).cast("timestamp_ntz"), t=raw) == want


def test_small_ones(spark):
    assert one(spark, X.lenient_number(F.col("t")), t="1.5") == 1.5
    assert one(spark, X.lenient_number(F.col("t")), t="x") == 0.0
    assert one(spark, X.post_url(F.col("c"), F.col("n")), c="@crypto_news", n="123") == "https://t.me/crypto_news/123"
    assert one(spark, X.post_url(F.col("c"), F.col("n")), c="-100", n="123") is None
    assert one(spark, X.token_estimate(F.col("t"), F.lit("gpt-5-nano")), t="abcd") == 2
    assert one(spark, X.token_estimate(F.col("t"), F.lit("x")), t="") == 0
    assert one(spark, X.local_time(F.lit("2025-10-15 08:00:00").cast("timestamp"), "Europe/Amsterdam")) == "15.10.2025 10:00"
    assert one(spark, X.mentions_channel(F.col("t")), t="hey @here") is True


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc é", max_size=30), st.text("abc é", max_size=30))
def test_common_length(a, b):
    assert P.common_length(a, b) == lcs(a, b)


def test_ratio():
    assert round(P.ratio("New wallet feature released", "New wallet feature rollout"), 3) == 0.792
    assert P.ratio("", "") == 1.0


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=120), st.integers(1, 30))
def test_chunks_keep_words(text, size):
    parts = P.chunks(text, size)
    assert all(len(p) <= size for p in parts)
    assert "".join("".join(p.replace("…", "").split()) for p in parts) == "".join(text.split())


def test_chunks():
    assert P.chunks("one two three four", 10) == ["one two …", "three …", "four"] or all(len(c) <= 10 for c in P.chunks("one two three four", 10))
    assert P.chunks(None, 5) == [""]
    assert P.chunks("x" * 10, 4) == ["xx …", "xx …", "xx …", "xxxx"]


def test_nested_text():
    assert P.nested_text('[{"type":"section","text":{"type":"mrkdwn","text":"Hello"}},{"elements":[{"text":"a"},{"x":{"text":"b"}}]}]') == "Hello a b"
    assert P.nested_text("{bad") == "" and P.nested_text(None) == "" and P.nested_text("[]") == ""


def test_reaction_map():
    assert P.reaction_map('{"results":[{"reaction":{"emoticon":"x"},"count":2},{"emoji":"x","total_count":3},{"count":1}]}') == {"x": 5}
    assert P.reaction_map('{"a": 2, "b": -3, "c": "z"}') == {"a": 2, "b": 0}
    assert P.reaction_map('[{"emoji":"y","count":1}]') == {"y": 1}
    assert P.reaction_map('"z"') == {"z": 1} and P.reaction_map("like") == {"like": 1} and P.reaction_map(None) == {}
