"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

A fingerprint summarises the word shingles of a text in 64 bits. Distinct
fingerprints that may lie within the radius meet in a bucket: the bits are cut
into ``radius + 2`` bands, two fingerprints within the radius agree in at least
two of them, so every pair of bands is a key. A bucket is compared bit-sliced:
its bit planes are stored vertically, 64 fingerprints a word, the distances of
one fingerprint to all others are updated by carry-save counters plane by
plane, and blocks whose distances all exceed the radius are abandoned. Planes
in which a whole bucket agrees, such as those of its key, are left out. Buckets
of a few fingerprints are compared directly, many buckets at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._graph import components
from skein.llm._store import staged

SEED = 42
#: Planes between two looks at which blocks, words of 64 fingerprints, are still within the radius.
LOOK = 8
#: Fingerprints of a bucket that are compared one by one; more are compared bit-sliced.
FEW = 16
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint_of(text: bytes | None, size: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned; zero for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(b" ".join(words), SEED)
    whole = b" ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    first = starts[: len(words) - size + 1].tolist()
    last = (starts[size:] - 1).tolist()
    h = np.fromiter((hashed(whole[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = 2 * total > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint_of(t.as_py()) for t in texts.cast(pa.binary())), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long: A-Z lower-cased, words cut at ASCII white space, 3-word shingles."""
    return _fingerprints(text)


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 x words: bit b of 64 fingerprints in each word of row b."""
    n = -(-len(fps) // 64)
    padded = np.zeros(n * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _beyond(low: np.ndarray, high: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Which distances exceed the radius, a bit each."""
    out = over
    if radius < 3:
        out = out | (high & low)
    if radius < 2:
        out = out | high
    if radius < 1:
        out = out | low
    return out


def within(fps: np.ndarray, planes: np.ndarray, probe: int, radius: int, bits: list[int] | None = None, abandoned: list[int] | None = None) -> np.ndarray:
    """Indexes into ``fps`` at ``radius`` or fewer bits from ``probe``.

    The counters hold a distance of up to 3 in two bit-sliced words and a third
    word that stays set once a distance is beyond; ``radius`` is at most 3.
    Every few planes, blocks all of whose distances are beyond are abandoned;
    their number is added to ``abandoned``. ``bits`` are the planes in which
    fingerprints and probe may differ.
    """
    live = np.arange(planes.shape[1])
    low, high, over = (np.zeros(len(live), np.uint64) for _ in range(3))
    if len(fps) % 64:
        over[-1] = _FULL << np.uint64(len(fps) % 64)  # the last block's empty places
    for step, b in enumerate(range(64) if bits is None else bits, 1):
        plane = planes[b] if len(live) == planes.shape[1] else planes[b, live]
        differs = ~plane if probe >> b & 1 else plane
        carry = low & differs
        low = low ^ differs
        over = over | (high & carry)
        high = high ^ carry
        if step % LOOK == 0:
            keep = _beyond(low, high, over, radius) != _FULL
            if not keep.all():
                if abandoned is not None:
                    abandoned.append(len(keep) - int(keep.sum()))
                live, low, high, over = live[keep], low[keep], high[keep], over[keep]
                if not len(live):
                    break
    near = ~_beyond(low, high, over, radius)
    hit = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(len(live), 64)
    at, bit = np.nonzero(hit)
    return live[at] * 64 + bit


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, abandoned: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that span the components of a bucket, or of the links between two parts of it.

    Fingerprints already reached need no second edge, so a bucket of n
    fingerprints gives fewer than n edges, however many pairs are near.
    """
    pool = left if right is None else np.concatenate([left, right])
    parent = np.arange(len(pool))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    base = 0 if right is None else len(left)
    target = left if right is None else right
    planes = _planes(target)
    varied = int(np.bitwise_or.reduce(pool) ^ np.bitwise_and.reduce(pool))
    bits = [b for b in range(64) if varied >> b & 1]
    edges = []
    for i, fp in enumerate(left.tolist()):
        for j in within(target, planes, fp, radius, bits, abandoned).tolist():
            a, b = root(i), root(base + j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((fp, int(target[j])))
    return edges


def band_keys(radius: int) -> list[tuple[int, int]]:
    """Masks (as band pairs' bits) of the keys: all pairs of ``radius + 2`` bands."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    bands = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(n)]
    return [(t, a | b) for t, (a, b) in enumerate(combinations(bands, 2))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _few(keys: list[np.ndarray], fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs of many small buckets at once: rows one place apart, two places and so on."""
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for d in range(1, FEW):
        same = np.logical_and.reduce([k[d:] == k[:-d] for k in keys])
        at = np.flatnonzero(same & ((side[d:] != side[:-d]) | (keys[2][d:] == keys[3][d:])))
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        a.append(fp[at])
        b.append(fp[at + d])
    return np.concatenate(a), np.concatenate(b)


def _compare(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    def compared(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Edges of whole buckets: rows of (t, k, i, j, fp, side) sorted by the first four."""
        *keys, fp, side = cols
        fp = fp.view(np.uint64)
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        few = np.repeat(sizes <= FEW, sizes)
        yield edges(*_few([k[few] for k in keys], fp[few], side[few], radius))
        for at, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            mine, own = fp[at : at + n], side[at : at + n]
            left, right = mine[own == 0], mine[own == 1]
            alone = keys[2][at] == keys[3][at]
            if len(left) and (alone or len(right)):
                found = forest(left, None if alone else right, radius)
                yield edges(np.array([a for a, _ in found], np.uint64), np.array([b for _, b in found], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last bucket of a batch waits for the rest of it, so two parts' fingerprints are held at a time."""
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = [np.concatenate(c) for c in zip(held, cols)] if held else cols
            other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in held[:4]]))
            if len(other):
                yield from compared([c[: other[-1] + 1] for c in held])
                held = [c[other[-1] + 1 :] for c in held]
        if held:
            yield from compared(held)

    return run


def near_edges(fps: DataFrame, radius: int = 2, part: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all within ``radius`` bits.

    ``fps`` has the one column fp, distinct. Buckets of more than ``part``
    fingerprints are cut into parts, and each two parts are a task of their
    own, so no task holds more than twice ``part`` fingerprints.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    masks = [(t, _signed(m)) for t, m in band_keys(radius)]
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in masks])).alias("key")
    ).select("key.t", "key.k", "fp")
    # small sides are written, so that a popular key's rows can be split over tasks
    met = staged(keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "met")
    rows = keyed.join(met, ["t", "k"]).withColumn("s", F.ceil(F.col("n") / part).cast("int"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("s") - 1),
        lambda o: F.struct(F.least("p", o).alias("i"), F.greatest("p", o).alias("j"), F.when(F.col("p") <= o, 0).otherwise(1).alias("side")),
    )
    dealt = rows.select("t", "k", F.explode(pairs).alias("x"), "fp").select("t", "k", "x.i", "x.j", "fp", "x.side")
    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(id_col, fp, component_id) for each row of ``docs``.

    component_id is the smallest id whose fingerprint can be reached by steps
    of ``radius`` or fewer bits. Texts without words, null ones included, have
    fingerprint zero and are linked like any others. A null id takes no part in
    the minimum, and a component of null ids only has a null component_id.
    Repeated rows are kept, each with its component. Other columns of ``docs``
    are not read.
    """
    d = staged(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "fingerprints")
    classes = staged(d.groupBy("fp").agg(F.min("id").alias("low")), "classes")
    roots = components(near_edges(classes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    member = staged(rooted.join(lows, "root").select(F.col("fp").alias("f"), "component_id"), "members")
    return d.join(member, d.fp == member.f).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One document of each component: the one with the smallest id.

    Rows that repeat an id are the same document and stay or go together; rows
    with a null id stay.
    """
    found = near_duplicates(docs, id_col, text_col, radius)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
