"""A gated recurrent language model in numpy, trained and applied by Spark.

Words of the training texts are counted in full. The most frequent ones form
classes of equal size; all others fall into classes by their shape. The network
gives the probability of the next word's class and, for a frequent word, of the
word in its class; a rare word has its share of its class's counts, where one
unknown word of each shape is counted as half a word.

The recurrent unit keeps a part f of its state and takes the rest from a
candidate c: h' = f h + (1 - f) c. Gate and candidate depend on the word read
alone (a minimal gated unit), so those of a whole window are found at once and
the recurrence itself costs two products a step. Both go through x / (1 + |x|),
and the softmax through straight lines between the powers of two, in training
and scoring alike: both are an order of magnitude cheaper than exp, and what is
divided by its sum is a distribution all the same.

Weights are learnt by truncated backpropagation on every training text, in
rounds: each round's texts are dealt to trainers whose number grows with the
texts, and the trainers' weights are averaged after the round.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._store import release, staged
from skein.llm._words import slices

#: The token after a text's last word; white space, so no word equals it.
END = "\n"
_ACCENTS = (re.compile("[äöüß]"), re.compile("[éèêëàâçîïôûùœ]"), re.compile("[ñóíúá¿¡]"))
SHAPES = 24
#: Rows of which a softmax is taken at a time, so that they stay in the cache.
CHUNK = 2048
#: Bytes of text that are cut into words at a time; cutting them takes a worker about twelve times as much memory, as numpy counts it.
TEXT = 6 << 20
#: Weights in a row of what a trainer sends.
PIECE = 4096
#: Trainers whose weights are added up before all are.
LOT = 64


def shape_of(word: str) -> int:
    """A rare word's class: its accents, length and whether it ends in a letter."""
    accent = 3
    if not word.isascii():
        low = word.lower()
        accent = next((i for i, p in enumerate(_ACCENTS) if p.search(low)), 3)
    length = 0 if len(word) <= 5 else 1 if len(word) <= 10 else 2
    return (accent * 3 + length) * 2 + (not word[-1:].isalpha())


def shapes_of(words: pa.Array) -> np.ndarray:
    """``shape_of`` of each word; those of ASCII alone are taken from their bytes, all at once."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    letter = pc.match_substring_regex(words, r"[A-Za-z]\z").to_numpy(zero_copy_only=False)
    out = (9 + (size > 5).astype(np.int64) + (size > 10)) * 2 + ~letter
    other = pc.invert(pc.string_is_ascii(words))
    out[other.to_numpy(zero_copy_only=False)] = [shape_of(w) for w in words.filter(other).to_pylist()]
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of each text's: A-Z lower-cased, cut at ASCII white space."""
    low = pc.ascii_lower(texts.cast(pa.string()).fill_null(""))
    split = pc.ascii_split_whitespace(low)
    words, counts = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at a text's ends leaves an empty word there
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
        words = words.filter(pa.array(full))
    return words, counts


@dataclass
class Vocabulary:
    """Words by falling count, as many as are known to every worker, and what the rest sums to."""

    words: list[bytes]
    counts: np.ndarray
    shapes: np.ndarray
    tokens: int
    distinct: int
    shape_tokens: np.ndarray
    shape_distinct: np.ndarray
    size: int  # words of a class
    classes: int

    @property
    def head(self) -> int:
        return min(len(self.words), self.size * self.classes)

    def index(self) -> pa.Array:
        """The words; a word's id is its place among them."""
        return pa.array(self.words, pa.string())

    def end(self) -> int:
        """Network input of the end token."""
        end = END.encode()
        return int(self.inputs(np.array([self.words.index(end) if end in self.words else -1 - shape_of(END)]))[0])

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """Network input of each id: a frequent word or a shape; ids below zero are -1 - shape."""
        top = self.size * self.classes
        if not self.words:
            return top - 1 - ids
        known = np.maximum(ids, 0)
        return np.where(ids < 0, top - 1 - ids, np.where(known < self.head, known, top + self.shapes[known]))

    def rare_log(self) -> np.ndarray:
        """log of the in-class probability of a shape's word with count c: this and log(c + 0.5)."""
        return -np.log(self.shape_tokens + 0.5 * (self.shape_distinct + 1))


class Network:
    """The weights in one vector, with views by name."""

    def __init__(self, classes: int, size: int, width: int = 16, state: int = 24, flat: np.ndarray | None = None):
        self.classes, self.size, self.width, self.state = classes, size, width, state
        self.shapes = {
            "embed": (classes * size + SHAPES, width), "wx": (width, 2 * state), "bx": (2 * state,),
            "wc": (state, classes + SHAPES), "bc": (classes + SHAPES,), "ww": (classes, state, size), "bw": (classes, size),
        }
        n = sum(math.prod(s) for s in self.shapes.values())
        self.flat = np.zeros(n, np.float32) if flat is None else np.asarray(flat, np.float32)
        at = 0
        for name, s in self.shapes.items():
            setattr(self, name, self.flat[at : at + math.prod(s)].reshape(s))
            at += math.prod(s)

    def start(self, vocabulary: Vocabulary, seed: int = 1) -> None:
        """Random weights, gates from a short to a long memory, and biases at the counts: without training this is
        the unigram of classes and words."""
        rng = np.random.default_rng(seed)
        self.embed[:] = rng.normal(0, 0.3, self.embed.shape)
        self.wx[:] = rng.normal(0, self.width**-0.5, self.wx.shape)
        self.bx[: self.state] = np.linspace(-4, 4, self.state)
        c = np.zeros(self.classes * self.size)
        c[: vocabulary.head] = vocabulary.counts[: vocabulary.head]
        by = np.concatenate([c.reshape(self.classes, self.size).sum(axis=1), vocabulary.shape_tokens]) + 0.5
        self.bc[:] = np.log(by / by.sum())
        held = np.arange(self.classes * self.size) < vocabulary.head
        self.bw[:] = np.where(held, np.log(c + 0.5), -30).reshape(self.classes, self.size)

    def gates(self, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """What each input, or each of some, keeps of the state, and its candidate."""
        a = _squash(self.embed[some] @ self.wx + self.bx)
        return np.ascontiguousarray(0.5 + 0.5 * a[:, : self.state]), np.ascontiguousarray(a[:, self.state :])

    def lines(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """``_lines`` of the classes' weights and of all words', and whether either is wide."""
        (wc, wide), (ww, wider) = _lines(self.wc, self.bc), _lines(self.ww, self.bw)
        return wc, ww, wide or wider

    def labels(self) -> np.ndarray:
        """The class of each input."""
        top = self.classes * self.size
        return np.concatenate([np.arange(top) // self.size, self.classes + np.arange(SHAPES)]).astype(np.int16)


def _squash(a: np.ndarray) -> np.ndarray:
    return a / (1 + np.abs(a))


_LINE, _ZERO, _LEAST = np.float32(2**23 / math.log(2)), np.float32(127 * 2**23), np.float32(2**23)


def _lines(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights, the biases below them, that give `_rise` its argument for a state followed by a one, and whether
    some argument may lie outside what a float's bits hold: states lie between -1 and 1, so the weights bound it."""
    reach = np.abs(w).sum(axis=-2)
    out = np.empty((*w.shape[:-2], w.shape[-2] + 1, w.shape[-1]), np.float32)
    np.multiply(w, _LINE, out=out[..., :-1, :])
    out[..., -1, :] = b * _LINE + _ZERO
    return out, bool((b + reach).max() > 60 or (b - reach).min() < -86)


def _rise(x: np.ndarray, wide: bool) -> np.ndarray:
    """exp with straight lines between the powers of two, never zero, of what `_lines` makes of logits; changes ``x``.

    A float's bits, read as a whole number, are such a line already. Where a
    value could grow too large its row is divided by a power of two, which
    leaves the shares as they are.
    """
    if wide:
        if x.size and float(x.max()) > 60 * _LINE + _ZERO:
            x -= np.ceil((x.max(axis=1, keepdims=True) - _ZERO) / _LEAST) * _LEAST
        np.maximum(x, _LEAST, out=x)
    return x.astype(np.int32).view(np.float32)


_ONES = np.ones(1 << 12, np.float32)


def _ones(n: int) -> np.ndarray:
    return _ONES[:n] if n <= len(_ONES) else np.ones(n, np.float32)


def _log_share(lines: np.ndarray, at: np.ndarray, wide: bool) -> np.ndarray:
    """log of the share of one place a row; changes ``lines``."""
    e = _rise(lines, wide)
    return np.log(e[np.arange(len(at)), at] / (e @ _ones(e.shape[1])))


def _parts(a: int, b: int) -> Iterator[tuple[int, int]]:
    for i in range(a, b, CHUNK):
        yield i, min(b, i + CHUNK)


def log_probabilities(net: Network, inputs: list[np.ndarray], group: int = 1024, window: int = 32) -> np.ndarray:
    """Natural log of each sequence's class and in-class probabilities (frequent words), summed.

    Sequences run side by side, the longest first, in windows of steps, more of
    them where fewer sequences are left, so that softmaxes are always taken of
    many rows; the state is carried from window to window, so a sequence is one
    whole.
    """
    lengths = np.array([len(x) for x in inputs], np.int64)
    return log_of(net, np.concatenate([np.zeros(0, np.int64), *inputs]), lengths, group, window)


def log_of(net: Network, flat: np.ndarray, lengths: np.ndarray, group: int = 1024, window: int = 32) -> np.ndarray:
    """``log_probabilities`` of sequences that follow each other in ``flat``."""
    out = np.zeros(len(lengths))
    keep, candidate = net.gates()
    take, labels, (wc, ww, wide) = (1 - keep) * candidate, net.labels(), net.lines()
    begin, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    for g in range(0, len(order), group):
        part = order[g : g + group]
        size, first = lengths[part], begin[part]
        h, at = np.zeros((len(part), net.state), np.float32), 0
        while at < size[0]:
            t = at + np.arange(min(window * group, int(size[0]) - at))
            active = np.searchsorted(-size, -t)  # sequences longer than t
            fits = max(1, int(np.searchsorted(np.cumsum(active), window * group, "right")))
            t, active, at = t[:fits], active[:fits], at + fits
            row = np.arange(active.sum()) - np.repeat(np.cumsum(active) - active, active)
            x = flat[first[row] + np.repeat(t, active)]
            kept, taken, states, p = keep[x], take[x], np.ones((len(x), net.state + 1), np.float32), 0
            for n in active.tolist():
                now = h[:n]
                states[p : p + n, :-1] = now
                now *= kept[p : p + n]
                now += taken[p : p + n]
                p += n
            which = np.argsort(labels[x], kind="stable")
            x, states = x[which], states[which]
            label = labels[x]
            log = np.empty(len(x), np.float32)
            for a, b in _parts(0, len(x)):
                log[a:b] = _log_share(states[a:b] @ wc, label[a:b], wide)
            edges = np.searchsorted(label, np.arange(net.classes + 1))
            for c in np.flatnonzero(np.diff(edges)):
                for a, b in _parts(edges[c], edges[c + 1]):
                    log[a:b] += _log_share(states[a:b] @ ww[c], x[a:b] - c * net.size, wide)
            out[part] += np.bincount(row[which], log, len(part))
    return out


class Trainer:
    """A network and Adam's moments, which windows of parallel streams change step by step."""

    def __init__(self, net: Network, end: int, rate: float = 0.01):
        self.net, self.end, self.rate = net, end, rate
        self.first, self.second, self.count = np.zeros_like(net.flat), np.zeros_like(net.flat), 0
        self.grad, self.labels = Network(net.classes, net.size, net.width, net.state), net.labels()
        self.small = np.int16 if len(self.labels) < 1 << 15 else np.int64  # short numbers are sorted faster

    def step(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The state after a window (streams x steps of inputs) that began in state ``h``."""
        net, ids = self.net, np.ascontiguousarray(ids.T)
        (steps, streams), flat = ids.shape, ids.ravel()
        order = np.argsort(flat.astype(self.small), kind="stable")
        x = flat[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        some, place = x[first], np.empty(len(x), np.int64)  # gates depend on the input alone: one of each
        place[order] = np.repeat(np.arange(len(some)), np.diff(first, append=len(x)))
        gate, candidate = net.gates(some)
        f, taken = (a[place].reshape(steps, streams, net.state) for a in (gate, (1 - gate) * candidate))
        ends = [np.flatnonzero(row == self.end) for row in ids]
        states = np.empty((steps + 1, streams, net.state), np.float32)
        states[0] = h
        for t in range(steps):
            np.multiply(states[t], f[t], out=states[t + 1])
            states[t + 1] += taken[t]
            states[t + 1][ends[t]] = 0
        self.grad.flat[:] = 0
        s = np.ones((len(x), net.state + 1), np.float32)
        s[:, :-1] = states[:-1].reshape(-1, net.state)[order]
        ds = np.empty((len(x), net.state), np.float32)
        ds[order] = self._softmax(s, x)
        ds = ds.reshape(f.shape)
        dn, dh = np.empty_like(f), np.zeros((streams, net.state), np.float32)  # what reaches each step's new state
        for t in range(steps - 1, -1, -1):
            dh[ends[t]] = 0
            dn[t] = dh
            dh *= f[t]
            dh += ds[t]
        both = np.empty((len(x), 2 * net.state), np.float32)
        both[:, net.state :] = dn.reshape(-1, net.state)[order]
        np.multiply(s[:, :-1], both[:, net.state :], out=both[:, : net.state])
        self._inputs(some, np.add.reduceat(both, first, axis=0), gate, candidate)
        self._adam()
        return states[-1]

    def _softmax(self, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The gradient of states that stand, each followed by a one, in the order of inputs ``x``; that of the
        softmax's weights is kept."""
        net, grad, label, scale = self.net, self.grad, self.labels[x], np.float32(1 / len(x))
        (wc, ww, wide), ds = net.lines(), np.empty((len(x), net.state), np.float32)

        def shares(lines: np.ndarray, at: np.ndarray) -> np.ndarray:
            e = _rise(lines, wide)
            e *= (scale / (e @ _ones(e.shape[1])))[:, None]
            e[np.arange(len(at)), at] -= scale
            return e

        for a, b in _parts(0, len(x)):
            d = shares(s[a:b] @ wc, label[a:b])
            both = d.T @ s[a:b]
            grad.wc += both[:, :-1].T
            grad.bc += both[:, -1]
            np.matmul(d, net.wc.T, out=ds[a:b])
        edges = np.searchsorted(label, np.arange(net.classes + 1))
        for c in np.flatnonzero(np.diff(edges)):
            for a, b in _parts(edges[c], edges[c + 1]):
                d = shares(s[a:b] @ ww[c], x[a:b] - c * net.size)
                both = d.T @ s[a:b]
                grad.ww[c] += both[:, :-1].T
                grad.bw[c] += both[:, -1]
                ds[a:b] += d @ net.ww[c].T
        return ds

    def _inputs(self, some: np.ndarray, sums: np.ndarray, f: np.ndarray, c: np.ndarray) -> None:
        """The gradient of the embedding and of what makes gates and candidates of it, from the sums over each input
        of its states times what reaches the next, and of the latter."""
        net, grad, k = self.net, self.grad, self.net.state
        da = np.empty_like(sums)
        da[:, :k] = (sums[:, :k] - c * sums[:, k:]) * (0.5 * (1 - np.abs(2 * f - 1)) ** 2)  # x / (1 + |x|) has the slope (1 - |y|)^2
        da[:, k:] = (1 - f) * sums[:, k:] * (1 - np.abs(c)) ** 2
        grad.wx[:] = (da.T @ net.embed[some]).T
        grad.bx[:] = _ones(len(some)) @ da
        grad.embed[some] = da @ net.wx.T

    def _adam(self) -> None:
        g, first, second = self.grad.flat, self.first, self.second
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= norm
        self.count += 1
        first *= np.float32(0.9)
        first += np.float32(0.1) * g
        second *= np.float32(0.999)
        g *= g
        g *= np.float32(0.001)
        second += g
        np.sqrt(second, out=g)
        g *= np.float32((1 - 0.999**self.count) ** -0.5)
        g += np.float32(1e-8)
        np.divide(first, g, out=g)
        g *= np.float32(self.rate / (1 - 0.9**self.count))
        self.net.flat -= g

    def sequence(self, tokens: np.ndarray, streams: int, window: int) -> None:
        """Steps over a sequence that is cut into ``streams`` at most, the last few tokens included."""
        streams = max(1, min(streams, len(tokens) // window))
        length = len(tokens) // streams
        grid = tokens[: streams * length].reshape(streams, length)
        h = np.zeros((streams, self.net.state), np.float32)
        for at in range(0, length, window):
            h = self.step(grid[:, at : at + window], h)
        if len(tokens) > streams * length:
            self.step(tokens[streams * length :, None], np.zeros((len(tokens) - streams * length, self.net.state), np.float32))


def train(net: Network, tokens: np.ndarray, end: int, streams: int = 32, window: int = 16, rate: float = 0.01, passes: int = 1) -> None:
    """Truncated backpropagation through time over a sequence of inputs, with Adam's steps.

    The sequence is cut into parallel streams. The state passes from window to
    window and starts anew after ``end``; gradients stop at a window's start.
    """
    trainer = Trainer(net, end, rate)
    for _ in range(passes):
        trainer.sequence(tokens, streams, window)


def train_stream(
    net: Network, texts: Iterator[np.ndarray], end: int, streams: int = 32, window: int = 16, rate: float = 0.01, trainer: Trainer | None = None,
    rate_at=lambda seen: 1.0,
) -> int:
    """``train`` in one pass over texts as they come; the number of tokens, all of which are learnt from.

    Each text goes whole to the stream with the fewest tokens waiting, so what
    is held doesn't grow with the number of texts. What waits at the end, less
    than a window in some stream, is cut into streams anew. ``rate_at`` is the
    share of the rate after so many tokens.
    """
    trainer, total, learnt = trainer or Trainer(net, end, rate), 0, 0
    waiting: list[deque[np.ndarray]] = [deque() for _ in range(streams)]
    sizes = np.zeros(streams, np.int64)
    h = np.zeros((streams, net.state), np.float32)

    def take(q: deque[np.ndarray], length: int) -> np.ndarray:
        out, n = [], 0
        while n < length:
            x = q.popleft()
            out.append(x[: length - n])
            if len(x) > length - n:
                q.appendleft(x[length - n :])
            n += len(out[-1])
        return np.concatenate(out)

    for x in texts:
        i = int(sizes.argmin())
        waiting[i].append(x)
        sizes[i] += len(x)
        total += len(x)
        if (windows := int(sizes.min()) // window) >= 8:
            grid = np.stack([take(q, windows * window) for q in waiting])
            for at in range(0, windows * window, window):
                trainer.rate = rate * rate_at(learnt)
                h = trainer.step(grid[:, at : at + window], h)
                learnt += streams * window
            sizes -= windows * window
    rest = [x for q in waiting for x in q]
    if rest:
        trainer.rate = rate * rate_at(learnt)
        trainer.sequence(np.concatenate(rest), streams, window)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0, TEXT):
            got = pc.value_counts(words_of(part.column(0))[0])
            yield pa.record_batch(
                [pa.concat_arrays([got.field("values"), pa.array([END])]), pa.concat_arrays([got.field("counts"), pa.array([part.num_rows], pa.int64())])], ["token", "c"]
            )


@F.arrow_udf(T.IntegerType())
def _shape(tokens: pa.Array) -> pa.Array:
    return pa.array(shapes_of(tokens.cast(pa.string())), pa.int32())


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, c, shape) over all texts, the end of each included, as a written table."""
    counted = docs.select(text_col).mapInArrow(_count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))
    out = staged(counted.withColumn("shape", _shape("token")), "counts")
    release(docs.sparkSession)
    return out


def fit_vocabulary(counts: DataFrame, known: int = 200_000, classes: int = 32, size: int = 96) -> Vocabulary:
    """The most frequent words, ``known`` at most, and totals over all.

    Words are known from a count on that few enough reach; the counts' steps
    are sixteenths of a doubling, so the histogram is a few hundred rows.
    """
    step = F.floor(F.log2("c") * 16)
    steps = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.col("s").desc()).collect()
    reach, least = 0, None
    for r in steps:
        reach += r.n
        if reach > known:
            break
        least = r.s
    some = counts.where(step >= least) if least is not None else counts.where(F.lit(False))
    top = some.toPandas().sort_values(["c", "token"], ascending=[False, True])  # known rows at most
    total = counts.agg(F.sum("c"), F.count("*")).first()
    head = min(len(top), classes * size)
    rest = counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # a row a shape
    tokens, distinct = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in rest:
        tokens[r["shape"]], distinct[r["shape"]] = r.c, r.v
    shapes, c = top["shape"].to_numpy(np.int64), top["c"].to_numpy(np.float64)
    np.subtract.at(tokens, shapes[:head], c[:head])
    np.subtract.at(distinct, shapes[:head], 1)
    return Vocabulary([t.encode() for t in top["token"]], c, shapes, int(total[0] or 0), int(total[1]), tokens, distinct, size, classes)


@dataclass
class Encoded:
    """Tokens of texts one after another, and the words among them that aren't known to every worker."""

    ids: np.ndarray  # -1 - shape for a word that isn't known
    lengths: np.ndarray
    words: pa.Array  # distinct ones of these
    rows: np.ndarray  # text, index into words and number of times, for each unknown word of each text
    which: np.ndarray
    times: np.ndarray


def encode(texts: pa.Array, index: Iterable[bytes]) -> Encoded:
    """The tokens of each text, its end last. ``index`` are the known words in the order of their ids."""
    words, counts = words_of(texts)
    known = index if isinstance(index, pa.Array) else pa.array(list(index), pa.string())
    lengths = counts + 1
    ends = np.cumsum(lengths) - 1
    at = np.ones(int(lengths.sum()), bool)
    at[ends] = False
    found = pc.index_in(words, value_set=known)
    ids = np.empty(len(at), np.int64)
    ids[at] = pc.fill_null(found, -1).to_numpy(zero_copy_only=False)
    end = pc.index_in(pa.array([END]), value_set=known)[0].as_py()
    ids[ends] = -1 if end is None else end
    rest = words.filter(found.is_null())
    unknown = np.flatnonzero(ids < 0)
    if end is None:
        mixed = np.full(len(unknown), END, object)
        mixed[at[unknown]] = rest.to_pylist()
        rest = pa.array(mixed, pa.string())
    coded = rest.dictionary_encode()
    code, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    ids[unknown] = -1 - shapes_of(distinct)[code]
    text = np.searchsorted(ends, unknown)
    pair, times = np.unique(text * len(distinct) + code, return_counts=True)
    return Encoded(ids, lengths, distinct, pair // max(1, len(distinct)), pair % max(1, len(distinct)), times)


def sequences(texts: pa.Array, index: Iterable[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The network's inputs of each text."""
    got = encode(texts, index)
    return np.split(vocabulary.inputs(got.ids), np.cumsum(got.lengths)[:-1]) if len(got.lengths) else []


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that come sorted by (lot, piece); one sum is held at a time."""
    key, weight, steps, total = None, 0.0, 0.0, np.zeros(0)

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([weight]), pa.array([steps]), pa.array([total], pa.list_(pa.float64()))], ["lot", "piece", "weight", "steps", "w"])

    for batch in batches:
        for lot, piece, n, k, w in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
            if (lot, piece) != key:
                if key is not None:
                    yield made()
                key, weight, steps, total = (lot, piece), 0.0, 0.0, np.zeros(len(w))
            weight, steps, total = weight + n, steps + k, total + w.values.to_numpy(zero_copy_only=False)
    if key is not None:
        yield made()


_SENT = "lot int, piece int, weight double, steps double, w array<double>"


def _sums(sent: DataFrame) -> DataFrame:
    return sent.repartition("lot", "piece").sortWithinPartitions("lot", "piece").mapInArrow(_added, _SENT)


def fit_network(
    docs: DataFrame, vocabulary: Vocabulary, trainer_tokens: int = 3_000_000, rounds: int = 4, streams: int = 256, window: int = 16, rate: float = 0.02,
    text_col: str = "text", seed: int = 1,
) -> Network:
    """Weights learnt by trainers in ``rounds``, averaged after each.

    Every text is trained on, whole, in one of the rounds. A round's texts are
    dealt to one trainer for each ``trainer_tokens`` tokens, row by row, so that
    neither a larger input nor a group of copies makes a trainer's work grow.
    Each trainer makes one pass over its texts as they come, from the mean of
    the round before, Adam's second moments included. Fewer tokens than
    a trainer's are one trainer's single round. The rate falls linearly.
    """
    start = Network(vocabulary.classes, vocabulary.size)
    start.start(vocabulary, seed)
    if not vocabulary.words:
        return start
    spark = docs.sparkSession
    trainers = max(1, round(vocabulary.tokens / trainer_tokens))
    rounds = min(rounds, trainers)
    trainers = -(-trainers // rounds)
    expected = vocabulary.tokens / rounds / trainers
    streams = int(min(streams, max(1, expected // (64 * window))))
    row = F.monotonically_increasing_id()  # with the text, so that copies are dealt like other texts
    texts = docs.select(F.col(text_col).alias("text"), row.alias("row")).withColumn("deal", F.xxhash64("text", "row", F.lit(3)))
    moments, steps = np.zeros_like(start.flat), 0
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, start.flat, moments, steps))  # known words and one model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, flat, second, count = shared.value
            index, net = v.index(), Network(v.classes, v.size, flat=flat.copy())
            end = v.end()
            trainer = Trainer(net, end, rate)
            trainer.second[:], trainer.count = second, count

            def dealt() -> Iterator[np.ndarray]:
                for batch in batches:
                    for part in slices(batch, 0, TEXT):
                        yield from sequences(part.column(0), index, v)

            n = train_stream(net, dealt(), end, streams, window, rate, trainer, lambda seen: 1 - 0.95 * (r + min(1.0, seen / expected)) / rounds)
            if n:
                both = np.concatenate([net.flat, trainer.second]).astype(np.float64) * n
                pieces = [both[i : i + PIECE] for i in range(0, len(both), PIECE)]
                lot = np.full(len(pieces), TaskContext.get().partitionId() // LOT, np.int32)
                weight, done = np.full(len(pieces), float(n)), np.full(len(pieces), float(trainer.count) * n)
                yield pa.record_batch([pa.array(lot), pa.array(range(len(pieces)), pa.int32()), pa.array(weight), pa.array(done), pa.array(pieces, pa.list_(pa.float64()))], ["lot", "piece", "weight", "steps", "w"])

        mine = texts.where(F.pmod(F.xxhash64("deal", F.lit(5)), F.lit(rounds)) == r) if rounds > 1 else texts
        sent = mine.repartition(trainers, "deal").select("text").mapInArrow(run, _SENT)
        if trainers > LOT:
            sent = _sums(sent).withColumn("lot", F.lit(0))
        got = sorted(_sums(sent.withColumn("lot", F.lit(0))).collect(), key=lambda x: x.piece)  # one model
        if got:
            both = np.concatenate([np.array(x.w) / x.weight for x in got]).astype(np.float32)
            n = len(start.flat)
            start, moments, steps = Network(vocabulary.classes, vocabulary.size, flat=both[:n].copy()), np.maximum(both[n:], 0), round(got[0].steps / got[0].weight)
        shared.destroy()
        release(spark)
    return start


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id_col, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the log10 probability under smoothed counts of single words,
    score that under the model. A null or empty text is the end token alone.
    Words that are not known to every worker are joined with the counts of all
    words. Repeated rows and null ids are rows of their own. Without training
    texts N and V are zero, and every token is an unknown one. Texts are scored
    whole at any length; an empty table gives an empty table; other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, net.flat))  # known words and one model
    n, v = vocabulary.tokens, vocabulary.distinct
    base_all = math.log10(n + 0.5 * (v + 1))
    rare = vocabulary.rare_log() / math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, flat = shared.value
        index, model = voc.index(), Network(voc.classes, voc.size, flat=flat)
        logc = np.log10(np.concatenate([voc.counts, np.full(SHAPES, 0.5)]) + 0.5)  # those of unknown words, last, are 0
        tail = np.concatenate([np.where(np.arange(len(voc.words)) < voc.head, 0, logc[: len(voc.words)] + rare[voc.shapes]), rare[::-1]])
        for batch in batches:
            for part in slices(batch, 2, TEXT):
                got = encode(part.column(2), index)
                rows = np.repeat(np.arange(part.num_rows), got.lengths)

                def total(x: np.ndarray) -> np.ndarray:
                    return np.bincount(rows, x, part.num_rows)

                model_log = log_of(model, voc.inputs(got.ids), got.lengths) / math.log(10)
                known = total(got.ids >= 0).astype(np.int64)
                base = total(logc[got.ids]) - base_all * got.lengths
                full = model_log + total(tail[got.ids])
                rest = pa.StructArray.from_arrays([got.words.take(pa.array(got.which)), pa.array(got.times.astype(np.int64))], ["token", "times"])
                edges = np.searchsorted(got.rows, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(got.lengths), pa.array(known), pa.array(base), pa.array(full), pa.ListArray.from_arrays(pa.array(edges), rest)],
                    ["row", "id", "n_tokens", "n_known", "base", "full", "rest"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    done = staged(rows.mapInArrow(run, "row long, id long, n_tokens long, n_known long, base double, full double, rest array<struct<token:string,times:long>>"), "scored")
    release(spark)
    # each word that few texts hold adds log10(c + 0.5), c being zero for a new one
    rest = done.select("row", F.explode("rest").alias("x")).select("row", "x.token", "x.times")
    met = rest.join(counts.select("token", "c"), "token", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) * F.col("times")
    zero = F.lit(0).cast("long")
    more = met.select("row", F.lit(None).cast("long").alias("id"), zero.alias("n_tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"), log.alias("base"), log.alias("full"))
    every = done.select("row", "id", "n_tokens", "n_known", "base", "full").unionByName(more)
    summed = every.groupBy("row").agg(F.max("id").alias(id_col), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "full")])
    return summed.select(id_col, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("full").alias("score"))


def fit_and_score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", **network: float) -> DataFrame:
    """``score`` of all rows of ``docs`` by a model of those where ``is_training`` holds."""
    training = docs.where(is_training)
    counts = count_tokens(training, text_col)
    vocabulary = fit_vocabulary(counts)
    net = fit_network(training, vocabulary, text_col=text_col, **network)
    return score(docs, counts, vocabulary, net, id_col, text_col)
