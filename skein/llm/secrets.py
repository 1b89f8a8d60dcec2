"""Secret scan: patterns, and weak parts reported when their complements are near.

A credential often comes in parts: an identifier, a secret and an endpoint. A
part alone is weak evidence. The scan lists the parts of every document as
intervals, widens each by the radius of its scope, and joins intervals of
complementary kinds within that scope.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts: an identifier by its name, an endpoint, a string that looks random.
IDENT = re.compile(r"(?:client|account|access_?key|app|user)_?(?:id|sid|name)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{6,})", re.I | re.A)
ENDPOINT = re.compile(r"(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])", re.A)

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_ORDER = {k: i for i, k in enumerate(KINDS)}
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_IDENT_WORDS = ("_id", "id:", "id=", "id\"", "id'", "id ", "sid", "name")


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _looks_random(s: str, bits: float) -> bool:
    mixed = any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)
    return mixed and entropy(s) >= bits


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three strong patterns, leftmost and without overlap a kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def linked_spans(text: str, base: list[tuple[str, int, int]], radius: int = 200, bits: float = 3.5) -> list[tuple[str, int, int]]:
    """Weak parts with complements within ``radius`` characters of the same scope.

    A scope is a run of text without an empty line; no part spans one. A weak
    secret needs an identifier (an access key counts), a weak identifier a
    secret (an assignment, a hex string or a weak secret), an endpoint both.
    Parts that overlap a strong match are not repeated, and a part is no
    complement of one that it overlaps. The join looks up the nearest interval
    on either side, so the work grows with the text's length times a logarithm.
    """
    low = text.lower()
    idents = [m.span() for m in IDENT.finditer(text)] if any(w in low for w in _IDENT_WORDS) and ("=" in text or ":" in text) else []
    access = [(s, e) for k, s, e in base if k == "access"]
    if not idents and not base:
        return []
    strong = [(s, e) for k, s, e in base if k in ("assign", "hex")]
    randoms = [m.span() for m in RANDOM.finditer(text) if _looks_random(m[0], bits)] if idents or access else []
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    taken = sorted((s, e) for _, s, e in base)
    reach = list(accumulate((e for _, e in taken), max))  # how far the spans up to each one go

    def free(s: int, e: int) -> bool:
        i = bisect_left(taken, (e, -1))
        return not i or reach[i - 1] <= s

    randoms, idents, ends = ([x for x in xs if free(*x)] for xs in (randoms, idents, ends))

    def joined(others: list[tuple[int, int]]):
        """Whether a part has one of ``others`` near it: the last to end before it or the first to start after it."""
        starts, stops = sorted(s for s, _ in others), sorted(e for _, e in others)

        def near(s: int, e: int) -> bool:
            scope, after, before = bisect_left(breaks, s), bisect_left(starts, e), bisect_right(stops, s) - 1
            right = after < len(starts) and starts[after] <= e + radius and bisect_left(breaks, starts[after]) == scope
            return right or (before >= 0 and stops[before] >= s - radius and bisect_left(breaks, stops[before] - 1) == scope)

        return near

    by_id, by_secret = joined(idents + access), joined(strong + randoms)
    found = [("secret", *x) for x in randoms if by_id(*x)]
    found += [("identifier", *x) for x in idents if by_secret(*x)]
    found += [("endpoint", *x) for x in ends if by_secret(*x) and by_id(*x)]
    return found


def scan_text(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text, by start and then by kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base), key=lambda x: (x[1], _ORDER[x[0]], x[2]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _scan(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in scan_text(t)] for t in texts.to_pylist()], pa.list_(SPAN))


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out``, the spans found in each whole text.

    Offsets are code points, the end exclusive; spans are sorted by start, then
    kind, then end. A null or empty text gives an empty list, and a very long one
    is scanned whole, in time that grows like its length. Rows are independent: repeated rows and null keys keep their
    own result, an empty table gives an empty table, and a column that is
    already called ``out`` is replaced.
    """
    return docs.withColumn(out, _scan(F.col(text_col)))


def span_digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@F.arrow_udf(T.StringType())
def _redact(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        if text and found:
            parts, at = [], 0
            for s in found:
                if s["end"] > at:
                    parts += [text[at : max(at, s["start"])], "" if s["start"] < at else "[secret]"]
                    at = s["end"]
            text = "".join(parts) + text[at:]
        out.append(text)
    return pa.array(out, pa.string())


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``[secret]``; null texts stay null."""
    spans = _scan(F.col(text_col))
    return docs.withColumn(text_col, _redact(F.col(text_col), spans))
