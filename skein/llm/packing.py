"""Packing along a space-filling curve.

Every document becomes token ids and, from the ids, a hashed vector projected
to a few dimensions. The documents are range-sorted by the Hilbert index of
that point, so neighbours along the curve have like content, and each range is
cut into sequences one after another.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm._store import staged

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_LOADED: dict[tuple[str, str | None], "Encoder"] = {}


class Encoder:
    """Token ids of texts by the tokenizer file at ``path``.

    With ``ranks``, the same byte-level vocabulary as a list of ranks, a faster
    encoder gives the same ids; texts that hold a special token's string still
    go through the tokenizer file, which turns it into that token. That file is
    loaded when it is first needed.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self._exact, self._fast = path, None, None
        if ranks is None:
            self.size, self.special = self.exact.get_vocab_size(), []
            return
        with open(ranks, "rb") as f:
            pairs = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = [t["content"] for t in added]
        self.size = max([*pairs.values(), *(t["id"] for t in added)]) + 1

    @property
    def exact(self) -> Tokenizer:
        if self._exact is None:
            self._exact = Tokenizer.from_file(self.path)
            self._exact.no_padding()
            self._exact.no_truncation()
        return self._exact

    def ids(self, text: str) -> list[int]:
        if self._fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """The encoder of these files, loaded once a worker."""
    if (path, ranks) not in _LOADED:
        _LOADED[path, ranks] = Encoder(path, ranks)
    return _LOADED[path, ranks]


def projection(n: int, dims: int) -> np.ndarray:
    """A row of +1 and -1 for each of the ids below ``n``, from a mixed hash of the id."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return ((x[:, None] >> np.arange(dims, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows), ``bits`` a dimension, vectorised over rows.

    The axes are turned into the transposed index by undoing the rotations and
    reflections of each level and then by a Gray code.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _tokenize(path: str, ranks: str | None, end_id: int, dims: int, bits: int):
    side = (1 << bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(path, ranks), TaskContext.get().partitionId() << 40
        signs = projection(coder.size, dims)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                points, blobs = np.empty((part.num_rows, dims)), []
                for i, text in enumerate(part.column(1)):
                    ids = np.array(coder.ids(text.as_py() or ""), np.int64)
                    v = signs[ids].sum(axis=0) / max(1.0, np.sqrt(len(ids)))
                    points[i] = np.clip((np.arctan(v / 4) / np.pi + 0.5) * side, 0, side)
                    blobs.append(np.append(ids, end_id).astype(_width(coder.size)).tobytes())
                keys, rows = pa.array(hilbert(points.astype(np.int64), bits)), pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.record_batch([part.column(0), keys, rows, pa.array([len(b) for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "hkey", "row", "bytes", "ids"])

    return run


def _width(vocabulary: int) -> str:
    """How ids are stored between the steps."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tail_sizes(rest: int) -> list[int]:
    """How a partition's last tokens are cut: the powers of two that add up to them, the largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(path: str, ranks: str | None, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, width = TaskContext.get().partitionId() << 40, _width(encoder(path, ranks).size)
        held: list[tuple[int | None, int, np.ndarray, int]] = []
        have = 0
        out: list[tuple] = []

        def flush(length: int) -> None:
            """Close a sequence of ``length`` tokens from the front of what is held."""
            nonlocal seq, have, held
            at, left = 0, []
            for k, (doc, start, ids, total) in enumerate(held):
                take = min(len(ids), length - at)
                if take <= 0:
                    left = held[k:]
                    break
                piece = ids[:take].tobytes()
                out.append((doc, start, take, zlib.crc32(piece), total, seq, at, *([piece] if with_ids else [])))
                at += take
                if take < len(ids):
                    left = [(doc, start + take, ids[take:], total), *held[k + 1 :]]
                    break
            held, have, seq = left, have - length, seq + 1

        def made() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * (7 + with_ids)
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.binary()) for c in cols[7:]], names)

        names = [c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(blob, width).astype("<u4")
                held.append((doc, 0, ids, len(ids)))
                have += len(ids)
                while have >= size:
                    flush(size)
                if len(out) >= 8192:
                    yield made()
        for length in tail_sizes(have):
            flush(length)
        yield made()

    return run


def pack(
    docs: DataFrame, size: int = 1024, path: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 0, dims: int = 4, bits: int = 10, with_ids: bool = False, part_bytes: int = 32 << 20,
) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``size`` tokens.

    A document is its whole text's ids and then ``end_id``; a null text counts
    as empty, so it is that one id. Documents follow each other along the
    curve; a sequence is filled to ``size`` and cuts a document where it must.
    Only the last tokens of a range-sorted partition are cut to powers of two,
    which need no padding either. Partitions hold about ``part_bytes`` of ids, so
    their number grows with the documents. Repeated rows, equal keys and null ids
    are separate documents, kept apart by their place in the first table, so
    none of them makes a partition large; a null id stays null. Texts are read whole at
    any length; an empty table gives an empty one; other columns aren't read. Returns doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset, and with ``with_ids`` the ids as bytes.
    """
    if path is None:
        path, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = staged(rows.mapInArrow(_tokenize(path, ranks, end_id, dims, bits), "doc_id long, hkey long, row long, bytes long, ids binary"), "tokens")
    parts = max(1, -(-(tokens.agg(F.sum("bytes")).first()[0] or 0) // part_bytes))
    along = tokens.repartitionByRange(parts, "hkey", "doc_id", "row").sortWithinPartitions("hkey", "doc_id", "row").select("doc_id", "ids")
    return along.mapInArrow(_pack(path, ranks, size, with_ids), PIECE + (", ids binary" if with_ids else ""))
