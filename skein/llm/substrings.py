"""Substring deduplication with a log-structured fingerprint index.

Every text is cut into blocks of consecutive windows that share the smallest
hash of their word runs (winnowing), so equal windows always lie in blocks of
equal fingerprint. The index holds the blocks of all documents so far as
sorted immutable runs, one a batch. A new batch is merge-joined with the runs
by fingerprint; fingerprints met before, or twice in the batch, are candidates.
Candidates are verified by the words themselves: blocks, and where they differ
their windows, are equal if a cryptographic digest of their words' bytes and
lengths is. Runs are merged into one when there are many. A manifest in the
index's folder names its runs, so a later application goes on from there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm._store import drop, release, run_dir, staged
from skein.llm._words import BASE, Sums, hashes_of, least_of, slices, split_words

#: Windows of a block at most, so that a long holds one bit for each.
BLOCK = 32
#: ``own`` is 2 if the run of the smallest hash occurs more than once in the block.
OCCURRENCE = "fp long, bh binary, doc_id long, th long, lo int, n int, own int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _digests(words: pa.Array, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """Digests of runs of words, from their bytes and lengths."""
    words = words.cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data, lengths = memoryview(words.buffers()[2] or b""), memoryview(np.diff(offsets).astype("<i4")).cast("B")
    out = []
    for a, b, i, j in zip(starts.tolist(), stops.tolist(), offsets[starts].tolist(), offsets[stops].tolist()):
        h = hashlib.blake2b(data[i:j], digest_size=16)
        h.update(lengths[4 * a : 4 * b])
        out.append(h.digest())
    return out


def _cut(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(text, first window, windows, fingerprint, digest of the content, own) of all blocks of the texts."""
    words, offsets = split_words(texts)
    none = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)), [], np.zeros(0, np.int32))
    if len(words) < window:
        return none
    at = np.arange(len(words) - gram + 1)
    hashed = Sums(hashes_of(words), BASE).runs(at, at + gram)
    least = least_of(hashed, window - gram + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    whole = owner[: len(least)] == owner[window - 1 : window - 1 + len(least)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~whole[:-1] | (owner[1 : len(least)] != owner[: len(least) - 1])
    starts = np.flatnonzero(new & whole)
    if not len(starts):
        return none
    # a run of windows ends before the next start or before the first window that isn't whole
    breaks = np.flatnonzero(new | ~whole)
    after = np.searchsorted(breaks, starts, "right")
    stops = np.where(after < len(breaks), breaks[np.minimum(after, len(breaks) - 1)], len(least))
    pieces = -(-(stops - starts) // BLOCK)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = np.repeat(starts, pieces) + step * BLOCK
    n = np.minimum(np.repeat(stops, pieces) - lo, BLOCK)
    content = _digests(words, lo, lo + n - 1 + window)
    doc = owner[lo]
    runs = n + window - gram
    first = np.cumsum(runs) - runs
    inside = np.arange(runs.sum()) + np.repeat(lo - first, runs)
    own = np.minimum(np.add.reduceat(hashed[inside] == np.repeat(least[lo], runs), first, dtype=np.int32), 2)
    return doc, lo - offsets[doc], n, least[lo], content, own


def _blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                doc, lo, n, fp, bh, own = _cut(part.column(2), window, gram)
                take = pa.array(doc)
                yield pa.record_batch(
                    [_signed(fp), pa.array(bh, pa.binary()), part.column(0).take(take), part.column(1).take(take), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own)],
                    ["fp", "bh", "doc_id", "th", "lo", "n", "own"],
                )

    return run


def _windows(window: int):
    """The digest of every window of the listed blocks of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                words, offsets = split_words(part.column(0))
                blocks = part.column(1)
                counts = blocks.value_lengths().to_numpy(zero_copy_only=False)
                flat = blocks.flatten()
                lo, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                base = np.repeat(offsets[:-1], counts) + lo
                each = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = base[each] + j
                take = pa.array(each)
                yield pa.record_batch([pa.array(_digests(words, at, at + window), pa.binary()), flat.field(0).take(take), flat.field(1).take(take), pa.array(j.astype(np.int32))], ["h", "fp", "bh", "j"])

    return run


class FingerprintIndex:
    """Runs of blocks below a folder that all executors share.

    ``window`` is the number of words that must repeat, ``gram`` the length of
    the hashed runs; more than ``max_runs`` runs are merged into one. A folder
    that holds an index is opened as it was left; it must have the same window
    and gram. Without ``path`` the index lasts as long as the application.
    What isn't named by the manifest, such as a run of an ``add`` that was cut
    short, isn't part of the index.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 35, gram: int = 8, max_runs: int = 4):
        self.spark, self.window, self.gram, self.max_runs = spark, window, gram, max_runs
        self.path = path or f"{run_dir(spark)}/index-{uuid.uuid4().hex}"
        self.version, self.runs, self.found = 0, [], []  # names of tables below the path
        for version in sorted(self._versions(), reverse=True)[:1]:
            state = json.loads(spark.read.text(f"{self.path}/manifest-{version:08d}").first()["value"])
            if (state["window"], state["gram"]) != (window, gram):
                raise ValueError(f"the index at {self.path} has windows of {state['window']} words and runs of {state['gram']}")
            self.version, self.runs, self.found = version, state["runs"], state["found"]

    def _versions(self) -> list[int]:
        """The finished manifests."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        names = [f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("manifest-")]
        return [int(p.getName().split("-")[1]) for p in names if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _save(self, gone: list[str] = []) -> None:
        """Write a new manifest, then delete the one before and the tables that aren't named any more."""
        state = json.dumps({"window": self.window, "gram": self.gram, "runs": self.runs, "found": self.found})
        self.version += 1
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:08d}")
        for name in [*gone, *([f"manifest-{self.version - 1:08d}"] if self.version > 1 else [])]:
            drop(self.spark, f"{self.path}/{name}")

    def _keep(self, df: DataFrame, name: str) -> str:
        name = f"{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _read(self, names: list[str], schema: str = OCCURRENCE) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{n}") for n in names])

    def _write(self, rows: DataFrame) -> str:
        return self._keep(rows.repartition("fp", "doc_id").sortWithinPartitions("fp", "bh"), "run")

    def add(self, docs: DataFrame) -> None:
        """Write a batch (doc_id, th, text) as a run and note its repeated fingerprints."""
        name = self._write(docs.select("doc_id", "th", "text").mapInArrow(_blocks(self.window, self.gram), OCCURRENCE))
        new = self._read([name]).groupBy("fp").agg((F.count("*") + F.max("own") - 1).alias("times"))
        again = new.where("times > 1").select("fp")
        if self.runs:
            again = again.unionByName(new.where("times = 1").select("fp").join(self._read(self.runs).select("fp").distinct(), "fp", "left_semi"))
        self.found.append(self._keep(again, "repeated"))
        self.runs.append(name)
        release(self.spark)
        if len(self.runs) > self.max_runs:
            self.compact()
        else:
            self._save()

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            old, self.runs = self.runs, [self._write(self._read(self.runs))]
            release(self.spark)
            self._save(old)

    def repeated(self, docs: DataFrame, last: int | None = None) -> DataFrame:
        """(doc_id, th, lo, mask): blocks with repeated windows; bit j stands for window lo + j.

        ``docs`` (doc_id, th, text) holds the documents of the index. Those with
        a block that shares its fingerprint with another, but not its
        content, or that repeats it itself are read again to verify them.
        ``last`` leaves out what repeats without the last so many batches.
        """
        # what a popular fingerprint is joined with is a written table, so that its rows can be split over tasks
        if not self.runs:
            return self.spark.createDataFrame([], "doc_id long, th long, lo int, mask long")
        fps = staged(self._read(self.found[-last:] if last else self.found, "fp long").distinct(), "repeated")
        same = staged(self._read(self.runs).join(fps, "fp"), "candidates")
        release(self.spark)
        kinds = staged(same.groupBy("fp", "bh").agg(F.count("*").alias("times"), F.max("own").alias("own"), F.min(F.struct("doc_id", "th", "lo", "n")).alias("at")), "kinds")
        several = kinds.groupBy("fp").agg((F.count("*") + F.max("own") - 1).alias("kinds")).where("kinds > 1").select("fp")
        several = staged(several, "several")
        rest = kinds.join(several, "fp").select("fp", "bh", "at.*").groupBy("doc_id", "th").agg(F.collect_list(F.struct("fp", "bh", "lo", "n")).alias("blocks"))
        rest = rest.withColumnsRenamed({"doc_id": "d", "th": "t"})
        texts = docs.join(rest, docs["doc_id"].eqNullSafe(rest["d"]) & (docs["th"] == rest["t"]))
        windows = staged(texts.select("text", "blocks").mapInArrow(_windows(self.window), "h binary, fp long, bh binary, j int"), "windows")
        release(self.spark)
        twice = staged(windows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "twice")
        masks = windows.join(twice, "h").groupBy("fp", "bh").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))
        full = kinds.where("times > 1").select("fp", "bh", F.lit(-1).cast("long").alias("mask"))
        mask = staged(full.unionByName(masks).groupBy("fp", "bh").agg(F.bit_or("mask").alias("mask")), "masks")
        release(self.spark)
        return same.join(mask, ["fp", "bh"]).select("doc_id", "th", "lo", F.expr("mask & (shiftleft(1L, n) - 1)").alias("mask"))


@F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.BinaryType()))]))
def _kept(texts: pa.Array, marks: pa.Array, windows: pa.Array) -> pa.Array:
    counts, removed, kept = [], [], []
    for text, found, window in zip(texts.cast(pa.binary()).to_pylist(), marks, windows.to_pylist()):
        words = (text or b"").split()
        counts.append(len(words))
        if found.is_valid and len(found):
            lo, mask = (found.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            hit = (mask[:, None].view(np.uint64) >> np.arange(BLOCK, dtype=np.uint64)) & np.uint64(1)
            at, j = np.nonzero(hit)
            s = lo[at] + j
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, np.minimum(s + window, len(words)), -1)
            keep = np.cumsum(edge[:-1]) == 0
            removed.append(int(len(words) - keep.sum()))
            kept.append(b" ".join(compress(words, keep.tolist())))
        else:
            removed.append(0)
            kept.append(b" ".join(words))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 8, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id_col, n_words, n_removed, kept (the kept words, joined by one space).

    Every word in a window of ``window`` words whose words also start anywhere
    else is removed, all occurrences alike. Null and empty texts have no words.
    A text that repeats, be it in a repeated row, repeats all its windows; rows
    with a null id are told apart by their text. The documents enter the index
    in ``batches`` batches by a hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    index = FingerprintIndex(spark, window=window, gram=gram)
    for b in range(batches):
        index.add(rows.where(F.pmod("th", F.lit(batches)) == b) if batches > 1 else rows)
    index.compact()
    marks = index.repeated(rows).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "mask")).alias("marks")).withColumnsRenamed({"doc_id": "d", "th": "t"})
    marks = staged(marks, "marks")
    release(spark)
    both = rows.join(marks, rows["doc_id"].eqNullSafe(marks["d"]) & (rows["th"] == marks["t"]), "left")
    return both.select(F.col("doc_id").alias(id_col), _kept("text", "marks", F.lit(window)).alias("r")).select(id_col, "r.*")
