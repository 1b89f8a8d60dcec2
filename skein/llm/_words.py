"""Words of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd factor of the rolling sums, which are taken modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i below n, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(max(n, 1), b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p)[:n])
    return out[0], out[1]


class Sums:
    """Hashes of any run of a sequence in constant time, from rolling sums."""

    def __init__(self, values: np.ndarray, base: int):
        self.power, self.inverse = powers(base, len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:-1], out=self.total[1:])

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.total[stop] - self.total[start]) * self.inverse[start])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, offsets of each text's) of UTF-8 texts, cut at ASCII white space. A null is an empty text."""
    split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    words, counts = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at a text's ends leaves an empty word there
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[full], minlength=len(counts))
        words = words.filter(pa.array(full))
    return words, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def hashes_of(words: pa.Array) -> np.ndarray:
    """XXH64 of each word's bytes; a word that occurs often is hashed once."""
    coded = words.dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else each


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of each text's words)."""
    words, offsets = split_words(texts)
    return hashes_of(words), offsets


def least_of(x: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every ``span`` consecutive values."""
    m, size = x, 1
    while size * 2 <= span:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < span:
        m = np.minimum(m[: len(m) - (span - size)], m[span - size :])
    return m


def slices(batch: pa.RecordBatch, column: int, bytes_: int = 4 << 20):
    """``batch`` in parts of about ``bytes_`` of text, a longer text by itself."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column).cast(pa.binary())], np.int64)
    ends = np.cumsum(size)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + bytes_, "right")))
        yield batch.slice(i, j - i)
        i = j
