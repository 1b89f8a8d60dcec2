"""Near copies by the words they share: the exact half of the near-duplicate stage.

Two texts are near copies if the sets of their word shingles have a Jaccard
similarity of ``least`` or more. Fingerprints of 64 bits can't tell such pairs
from others at this distance, so candidates come from MinHash: of each text 80
minima are kept, a byte of each as its sketch and 20 keys of 4 of them. Texts
that share a key meet; their sketches, which a pair at 0.8 passes in all but 4
of a million cases, leave few pairs, and each of those is checked by its exact
similarity. A pair at 0.8 shares no key with a chance of 3 in 100,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm._graph import components
from skein.llm._store import release, staged
from skein.llm._words import mixed, slices, word_hashes

#: Bands, and minima in each.
BANDS, ROWS = 20, 4
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 0x5EED) | np.uint64(1)
_PAIR = "a long, b long"


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    lowered = pa.array([None if t is None else t.lower() for t in texts.cast(pa.binary()).to_pylist()], pa.binary())
    words, edges = word_hashes(lowered)
    for a, b in zip(edges[:-1], edges[1:]):
        w = words[a:b]
        n = min(size, len(w))
        if not n:
            yield w
            continue
        h = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            h = mixed(h + w[k : len(w) - n + 1 + k])
        yield np.unique(h)


def _minima(s: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over a set, some elements at a time."""
    out = np.full(len(_FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 1024):
        h = s[None, i : i + 1024] * _FACTORS[:, None]
        h ^= h >> np.uint64(32)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            ids, sizes, sketches, keys = [], [], [], []
            for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1))):
                if len(s):
                    m = mixed(_minima(s))
                    h = np.zeros(BANDS, np.uint64)
                    for r in range(ROWS):
                        h = mixed(h + m.reshape(BANDS, ROWS)[:, r], r + 1)
                    ids.append(i)
                    sizes.append(len(s))
                    sketches.append(m.astype(np.uint8).tobytes())
                    keys.append(h.view(np.int64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "sk", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            sets = [s.view(np.int64) for s in shingle_sets(part.column(1))]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])


def _matrix(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _likely(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of sketches may be near copies, and the bytes in which they agree.

    Sizes that differ too much rule out the similarity; the number of equal
    bytes may fall short of its mean by four and a half deviations.
    """
    same = x == y
    n = x.shape[1]
    floor = least * n - 4.5 * (n * least * (1 - least)) ** 0.5
    return (same.sum(axis=1) >= floor) & (np.minimum(nx, ny) >= least * np.maximum(nx, ny)), same


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _column(c: pa.Array) -> np.ndarray:
    """Numbers as they are, sketches as rows of bytes, sets as an array each."""
    if pa.types.is_binary(c.type):
        return _matrix(c)
    if pa.types.is_list(c.type):
        out = np.empty(len(c), object)
        for i, x in enumerate(c):
            out[i] = x.values.to_numpy(zero_copy_only=False)
        return out
    return c.to_numpy(zero_copy_only=False)


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of rows that come sorted by their first ``keys`` columns, cut between keys only."""
    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            cols = [_column(c) for c in batch.columns]
            held = [np.concatenate(c) for c in zip(held, cols)] if held else cols
            other = np.flatnonzero(np.any([c != c[-1] for c in held[:keys]], axis=0))
            if len(other):
                yield [c[: other[-1] + 1] for c in held]
                held = [c[other[-1] + 1 :] for c in held]
    if held:
        yield held


def _likely_rows(cols: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of likely pairs of rows (t, k, p, q, side, id, n, sk) of one key and parts p and q.

    Rows of two parts meet those of the other side only. A pair that shares several bands is of the first one.
    """
    t, k, p, q, side, i, n, sk = cols
    for d in range(1, len(t)):
        near = (t[d:] == t[:-d]) & (k[d:] == k[:-d]) & (p[d:] == p[:-d]) & (q[d:] == q[:-d])
        if not near.any():  # nor are rows farther apart of one key
            break
        at = np.flatnonzero(near & ((side[d:] != side[:-d]) | (p[d:] == q[d:])) & (i[d:] != i[:-d]))
        ok, same = _likely(sk[at], sk[at + d], n[at], n[at + d], least)
        at, same = at[ok], same[ok]
        at = at[same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == t[at]]
        if len(at):
            yield at, at + d


def _met(least: float):
    """Likely pairs of rows that come sorted by t, k, p and q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_keys(batches, 4):
            for a, b in _likely_rows(cols, least):
                yield _pairs(cols[5][a], cols[5][b])

    return run


def _verified(least: float):
    """Near copies among rows (t, k, p, q, side, id, n, sk, s) that come sorted by the first four.

    Pairs that earlier ones tie already aren't compared, so a task gives fewer edges than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *cols, sets in _whole_keys(batches, 4):
            parent = np.arange(len(sets))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            found = []
            for at, to in _likely_rows(cols, least):
                for x, y in zip(at.tolist(), to.tolist()):
                    if (a := root(x)) != (b := root(y)):
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if both >= least * (len(sets[x]) + len(sets[y]) - both):
                            parent[max(a, b)] = min(a, b)
                            found.append((x, y))
            if found:
                at, to = np.array(found).T
                yield _pairs(cols[5][at], cols[5][to])

    return run


def _led(least: float):
    """Likely pairs of rows (id, n, sk) and their key's leader (lead, ln, lsk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, n, lead, ln = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3, 4))
            ok, _ = _likely(_matrix(batch.column(2)), _matrix(batch.column(5)), n, ln, least)
            ok &= i != lead
            yield _pairs(i[ok], lead[ok])

    return run


def _dealt(rows: DataFrame, sketches: DataFrame, part: int) -> DataFrame:
    """Rows (t, k, id, c) with their sketches, dealt to the pairs of parts of their key; a part has about ``part`` ids."""
    parts = F.ceil(F.col("c") / part).cast("int")
    parted = rows.select("t", "k", "id", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q"), F.when(F.col("own") <= o, 0).otherwise(1).alias("side")))
    more = sketches.columns[1:]
    return parted.join(sketches, "id").select("t", "k", F.explode(both).alias("x"), "id", *more).select("t", "k", "x.p", "x.q", "x.side", "id", *more)


def _sorted(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("t", "k", "p", "q").sortWithinPartitions("t", "k", "p", "q")


def keyed(keys: DataFrame) -> DataFrame:
    """The rows (t, k, id) of keys that several have, with their number c and a leader, another one in each band."""
    # a small side is written, so that a popular key's rows can be split over tasks
    lead = F.min(F.struct(F.xxhash64("id", "t").alias("h"), "id"))["id"]
    met = staged(keys.groupBy("t", "k").agg(F.count("*").alias("c"), lead.alias("lead")).where("c > 1"), "met")
    return staged(keys.join(met, ["t", "k"]).select("t", "k", "id", "c", "lead"), "rows")


def likely_pairs(rows: DataFrame, sketches: DataFrame, least: float, whole: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a key and may be near copies.

    ``rows`` are those of ``keyed``, ``sketches`` has id, n and sk. A key of
    ``whole`` ids or fewer has all its pairs looked at. Of more, each id meets
    its leader, so that a group's pairs don't grow with its square.
    """
    pairs = _sorted(_dealt(rows.where(F.col("c") <= whole), sketches, whole)).mapInArrow(_met(least), _PAIR)
    big = rows.where(F.col("c") > whole)
    leads = big.select("t", "k", "lead").distinct().join(sketches.select(F.col("id").alias("lead"), F.col("n").alias("ln"), F.col("sk").alias("lsk")), "lead")
    leads = staged(leads.dropDuplicates(["t", "k"]), "leads")
    led = big.select("t", "k", "id").join(leads, ["t", "k"]).join(sketches, "id").select("id", "n", "sk", "lead", "ln", "lsk")
    return pairs.unionByName(led.mapInArrow(_led(least), _PAIR)).distinct()


def crowded_edges(docs: DataFrame, rows: DataFrame, sketches: DataFrame, least: float, part: int) -> DataFrame:
    """Edges (a, b) that tie all near copies among the ids of each key, compared in full.

    Parts of ``part`` ids meet each other, two of them in a task, which holds
    their sets and compares those pairs whose sketches are alike.
    """
    named = staged(rows.select("id").distinct(), "named")
    sets = staged(docs.join(named, "id", "left_semi").mapInArrow(_sets, "id long, s array<long>"), "sets")
    return _sorted(_dealt(rows, sketches.join(sets, "id"), part)).mapInArrow(_verified(least), _PAIR).distinct()


def near_edges(docs: DataFrame, pairs: DataFrame, least: float = 0.8) -> DataFrame:
    """The pairs whose exact similarity is ``least`` or more; ``docs`` has id and text."""
    named = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "named")
    sets = staged(docs.join(named, "id", "left_semi").mapInArrow(_sets, "id long, s array<long>"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both >= least * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, whole: int = 32, part: int = 1024) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id.

    A first round links all pairs of ordinary keys and, in keys of very many
    ids, those with a leader, which leaves few of a large group. A second one
    compares what is left in such keys in full. So no two documents that stay
    are near copies that share a key. Rows that repeat an id are the same
    document; rows with a null id, and texts without words (null or empty),
    stay. Texts are compared whole at any length; an empty table stays empty;
    other columns pass through, whatever their names.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = staged(rows.mapInArrow(_sketched, "id long, n long, sk binary, keys array<long>"), "sketches")
    sketches = made.select("id", "n", "sk")
    rows_of = keyed(made.select("id", F.posexplode("keys").alias("t", "k")))
    edges = staged(near_edges(rows, staged(likely_pairs(rows_of, sketches, least, whole), "pairs"), least), "near")
    gone = staged(components(edges).where(F.col("node") != F.col("root")).select("node"), "gone")
    release(docs.sparkSession)
    crowded = rows_of.where(F.col("c") > whole).select("t", "k", "id").join(gone, F.col("id") == F.col("node"), "left_anti")  # all other keys are done
    if crowded.head(1):
        edges = staged(crowded_edges(rows, keyed(crowded), sketches, least, part), "near")
        gone = gone.unionByName(staged(components(edges).where(F.col("node") != F.col("root")).select("node"), "gone"))
        release(docs.sparkSession)
    return docs.join(gone, docs[id_col] == gone["node"], "left_anti")
