"""Toxicity: a weighted lexicon matched over folded text.

Texts are folded first: A-Z and other capitals lower-cased, letters that look
like Latin ones replaced by them, digits and signs used as letters likewise.
An Aho-Corasick automaton then finds lexicon entries (whole words, or stems at
a word's start) and exception phrases in one pass; an entry inside an exception
phrase doesn't count. The sum of the weights is normalised by the length of the
text and mapped to 0..1 by a logistic curve.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._store import staged

#: Letters and signs folded to the Latin letter that they imitate.
HOMOGLYPHS = {
    "а": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "һ": "h", "і": "i", "ι": "i",
    "ї": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "р": "p", "ρ": "p",
    "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ν": "v", "ѵ": "v", "ѡ": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
}
#: Digits and signs that stand for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Harmless phrases that hold an entry.
EXCEPTIONS = ("pathetic fallacy", "class clown", "clown fish", "clown car", "trash can", "trash bin", "trash talk", "sore loser", "stupid question", "pond scum", "worthless stock")

_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_WORD = regex.compile(r"\p{L}+")
STEMS = tuple(range(3, 11))


def fold(text: str) -> str:
    """Lower-cased, homoglyphs and substitutes replaced."""
    return text.lower().translate(_FOLD)


def entries_of(text: str) -> set[str]:
    """What a text may contribute to a lexicon: ``word`` and ``stem*`` entries."""
    words = {w for w in _WORD.findall(fold(text)) if 3 <= len(w) <= 40}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    """Weighted entries, and the curve from normalised weight to score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float, float] = (-4.0, 1.0, 1.0, 0.0)
    _auto: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_auto": None}

    def _automaton(self):
        if self._auto is None:
            auto = ahocorasick.Automaton()
            for e, w in self.weights.items():
                auto.add_word(e.rstrip("*"), (len(e.rstrip("*")), w, e.endswith("*")))
            for e in self.exceptions:
                auto.add_word(fold(e), (len(fold(e)), None, False))
            auto.make_automaton()
            self._auto = auto
        return self._auto

    def measure(self, text: str | None) -> tuple[float, float, int]:
        """(sum of the weights of the entries found, the largest of them, number of words); an entry found again adds a tenth.

        Of entries that overlap the first counts, of those that start alike the
        heaviest. An entry inside an exception phrase doesn't count.
        """
        if not text:
            return 0.0, 0.0, 0
        t = fold(text)
        n = len(t.split())
        auto = self._automaton()
        if not len(auto):
            return 0.0, 0.0, n
        found, exempt = [], []
        for end, (size, w, stem) in auto.iter(t):
            start, stop = end - size + 1, end + 1
            if (start and t[start - 1].isalpha()) or (not stem and stop < len(t) and t[stop].isalpha()):
                continue
            (exempt if w is None else found).append((start, stop, w))
        total, most, at, seen = 0.0, 0.0, -1, set()
        exempt.sort()
        opens, reach = [a for a, _, _ in exempt], list(accumulate((b for _, b, _ in exempt), max))  # how far the phrases up to each one go
        for start, stop, w in sorted(found, key=lambda x: (x[0], -x[2])):
            before = bisect_right(opens, start)
            if start >= at and not (before and reach[before - 1] >= stop):
                total, most, at = total + (w if t[start:stop] not in seen else w / 10), max(most, w), stop
                seen.add(t[start:stop])
        return total, most, n

    def inputs(self, total: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Constant, weight by itself and weight a hundred words (both damped), and the largest weight."""
        return np.stack([np.ones_like(total), np.log1p(total), np.log1p(100 * total / np.maximum(n, 20)), most], axis=1)

    def score(self, total: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(total, most, n) @ np.array(self.curve), -30, 30)))

    def fit_curve(self, total: np.ndarray, most: np.ndarray, n: np.ndarray, toxic: np.ndarray, ridge: float = 0.1) -> None:
        """Logistic regression by Newton steps."""
        x = self.inputs(total, most, n)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (toxic - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.curve = tuple(float(v) for v in w)


def _sure(n: float) -> float:
    """Few toxic documents are weak evidence, so their number counts less its spread."""
    return max(0.0, n - 1.5 * math.sqrt(n))


def weight_of(t: float, c: float, toxic: int, clean: int) -> float:
    """The logarithm of how much likelier an entry is in a toxic document, from the numbers of documents of each kind."""
    return math.log((_sure(t) + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int, least: float = 1.5) -> dict[str, float]:
    """Entries and weights from (entry, toxic documents, clean documents) counts.

    An entry that a chosen shorter stem covers is left out, unless it weighs
    more by a half.
    """
    weigh = {e: weight_of(t, c, toxic, clean) for e, t, c in rows}
    count = {e: t for e, t, _ in rows}
    names = sorted(count)
    out: dict[str, float] = {}

    def narrow(e: str) -> str:
        """The longest entry that a stem's toxic documents share, nearly all of them: it does the stem's work and touches less else."""
        word, best = e.rstrip("*"), e
        for i in range(bisect_left(names, word), len(names)):
            if not names[i].startswith(word):
                break
            if count[names[i]] >= 0.97 * count[e] and len(names[i].rstrip("*")) > len(best.rstrip("*")):
                best = names[i]
        return best

    for e in sorted((e for e, w in weigh.items() if w >= least), key=lambda e: (len(e.rstrip("*")), e)):
        word = e.rstrip("*")
        covers = [out[s] for n in STEMS if n <= len(word) and (s := word[:n] + "*") in out and s != e]
        if not covers or weigh[e] > max(covers) + 0.5:
            out[e] = weigh[e]
    return {n: weigh[n] for n in map(narrow, out)}


def phrases_of(lexicon: Lexicon, text: str) -> set[str]:
    """The pairs of words, folded and one space apart, of which one is an entry of the lexicon."""
    words = fold(text).split()
    known = [any(e in lexicon.weights for e in (w, *(w[:n] + "*" for n in STEMS if len(w) > n))) for w in words]
    return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], known, known[1:]) if x != y}


def _tally(of: Callable[[str], set[str]]):
    """(entry, toxic documents, clean documents) of a partition's texts; the empty entry counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tally[int(toxic == 1)].update(of(text))
                tally[int(toxic == 1)][""] += 1
        keys = list(tally[0].keys() | tally[1].keys())
        yield pa.record_batch([pa.array(keys, pa.string()), *(pa.array([tally[c][k] for k in keys], pa.int64()) for c in (1, 0))], ["entry", "t", "c"])

    return run


def _counted(rows: DataFrame, of: Callable[[str], set[str]]) -> DataFrame:
    counted = rows.select("text", F.col("toxic").cast("long")).mapInArrow(_tally(of), "entry string, t long, c long")
    return counted.groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def fit_lexicon(docs: DataFrame, labels: DataFrame, max_rows: int = 24_000, support: int = 4, least: float = 1.5) -> Lexicon:
    """A lexicon from labelled documents.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; the caller leaves
    out what must not be learnt from. At most ``max_rows`` labelled documents
    are used, those with the smallest hash of the id; rows that repeat an id
    give one document, the text that sorts first. Two thirds of them, equal
    texts counted once, give the entries: all that ``support`` toxic documents
    hold with a weight of ``least`` or more. Pairs of an entry and another word
    that ``support`` clean documents hold and no toxic one become exceptions,
    beside the given ones. The other third fits the curve. A document labelled
    twice counts as toxic if one label says so, as does a text that repeats;
    null ids and labels are left out, null texts are empty ones. Without both classes,
    an empty table included, the lexicon is empty and every score is the
    curve's start. Texts are read whole; other columns aren't read.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    some = some.select("doc_id", "toxic", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)) == 0).alias("held"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")  # max_rows rows at most
    rows = staged(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("held").alias("held")), "labelled")
    first = rows.where("not held").groupBy("text").agg(F.max("toxic").alias("toxic"))
    counts = staged(_counted(first, entries_of), "entries")
    toxic, clean = next(((r.t, r.c) for r in counts.where("entry = ''").collect()), (0, 0))
    lexicon = Lexicon({})
    if toxic and clean:
        sure = F.greatest(F.lit(0.0), F.col("t") - 1.5 * F.sqrt("t"))
        weight = F.log((sure + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
        # as many as max_rows documents can support; stems that only narrow others count, whatever they weigh
        got = counts.where((F.col("t") >= support) & (F.col("entry") != "") & (weight >= least - 1e-9)).collect()
        lexicon = Lexicon(choose([(r.entry, r.t, r.c) for r in got], toxic, clean, least))
        harmless = _counted(first, lambda text: phrases_of(lexicon, text)).where((F.col("c") >= support) & (F.col("t") == 0) & (F.col("entry") != ""))
        lexicon.exceptions = (*lexicon.exceptions, *sorted(r.entry for r in harmless.collect()))
    held = rows.where("held").select("text", "toxic").mapInArrow(_measured(lexicon), "total double, most double, n long, toxic long").toPandas()  # a third of max_rows rows
    if held["toxic"].nunique() > 1:
        lexicon.fit_curve(held["total"].to_numpy(), held["most"].to_numpy(), held["n"].to_numpy(), (held["toxic"] == 1).to_numpy().astype(float))
    return lexicon


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lexicon.measure(t) for t in b.column(0).to_pylist()]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]
            yield pa.record_batch([*cols, b.column(1).cast(pa.int64())], ["total", "most", "n", "toxic"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with ``out``, a score from 0 to 1 of each whole text.

    Null and empty texts score as texts without a match; very long ones are read
    whole. Each row is scored by itself: repeated rows get the same score, an
    empty table gives an empty table, and other columns pass through (a column
    already called ``out`` is replaced).
    """

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        got = np.array([lexicon.measure(t) for t in texts.to_pylist()], float).reshape(-1, 3)
        return pa.array(lexicon.score(got[:, 0], got[:, 1], got[:, 2]))

    return docs.withColumn(out, score(F.col(text_col)))
