"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets, the longest first. For a
query with a known lower bound of its k-th score, a bucket whose longest vector
can't reach it is skipped; in the others the bound gives a local threshold for
the cosine. A high threshold prunes by coordinates: the query's largest ones
bound the same coordinates of any vector within the angle. A low one prunes by
length: only the prefix of the bucket that is long enough remains. What remains
is verified by products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm._store import staged

#: Above this cosine coordinates prune, below it length.
COORDINATE_FROM = 0.55
#: Coordinates looked at for a query.
FOCUS = 6


def quantised(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector with a null or non-finite one."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(embedding.isNotNull() & good, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, shorter vectors padded by zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


BLOCK = "block long, rows int, dims int, longest double, ids binary, vectors binary"


def _blocks(size: int, dims: int):
    """Rows (id, v) to blocks of ``size`` rows, in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, rows = np.zeros(0, np.int64), np.zeros((0, dims), np.int64)

        def made(k: int) -> pa.RecordBatch:
            nonlocal number, ids, rows
            part, ids, of, rows = rows[:k], ids[k:], ids[:k], rows[k:]
            longest = float(np.sqrt((part.astype(float) ** 2).sum(axis=1).max()))
            out = pa.record_batch([[number], pa.array([len(part)], pa.int32()), pa.array([dims], pa.int32()), [longest], [of.tobytes()], [part.tobytes()]], ["block", "rows", "dims", "longest", "ids", "vectors"])
            number += 1
            return out

        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False)])
            rows = np.concatenate([rows, _matrix(batch.column(1), dims)])
            while len(ids) >= size:
                yield made(size)
        if len(ids):
            yield made(len(ids))

    return run


class Bucket:
    """A bucket's vectors by falling length, with what pruning needs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.exact_float = self.vectors.size == 0 or np.abs(self.vectors).max() < 1 << 24
        self.floats = self.vectors.astype(float)
        with np.errstate(invalid="ignore"):
            self.unit = np.where(self.norms[:, None] > 0, self.floats / self.norms[:, None], 0).T.copy()

    def products(self, at: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
        # floats hold the sums exactly while they stay below 2**53
        if self.exact_float and np.abs(query).max(initial=0) * max(1, len(query)) < 1 << 29:
            return (self.floats[at] @ query.astype(float)).astype(np.int64)
        return self.vectors[at] @ query

    def candidates(self, query: np.ndarray, norm: float, bound: float) -> np.ndarray | slice:
        """Positions of all vectors whose product with the query may reach ``bound``."""
        if not len(self.ids) or bound == -np.inf or bound <= 0 or norm == 0:
            return slice(None)
        slack = 1e-9
        enough = int(np.searchsorted(-self.norms, -bound / norm * (1 - slack), "right"))
        if not enough:
            return slice(0, 0)
        cosine = bound / (norm * self.norms[0]) * (1 - slack)
        if cosine < COORDINATE_FROM or enough < 64:
            return slice(0, enough)
        spread = np.arccos(min(1.0, cosine)) + slack
        unit = query / norm
        left = np.arange(enough)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + spread)) - slack, np.cos(max(0.0, angle - spread)) + slack
            c = self.unit[f, left]
            left = left[(c >= low) & (c <= high)]
            if len(left) < 32:
                break
        return left

    def best(self, query: np.ndarray, own: int, k: int, bound: float, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of up to k vectors that reach ``bound``, with an id up to ``upto`` if they only equal it, best first, ties to the smaller id."""
        at = self.candidates(query, float(np.sqrt((query.astype(float) ** 2).sum())), bound)
        ids, scores = self.ids[at], self.products(at, query)
        good = ((scores > bound) | ((scores == bound) & (ids <= upto))) & (ids != own)
        ids, scores = ids[good], scores[good]
        if len(ids) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def _search(k: int):
    """Pairs (queries, bucket) to the best of each query.

    Pairs of one block of queries come one after another; what its queries have
    found so far raises their bounds for the next bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, queries, bounds, upto, found = None, None, None, None, None, []
        last, bucket = None, None

        def made() -> pa.RecordBatch:
            n = [len(f[0]) for f in found]
            return pa.record_batch(
                [pa.array(np.repeat(mine, n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                ["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                dims = r["dims"]
                if r["q_block"] != now:
                    if found:
                        yield made()
                    now, mine = r["q_block"], np.frombuffer(r["q_ids"], np.int64)
                    queries = np.frombuffer(r["q_vectors"], np.int64).reshape(-1, dims)
                    bounds = np.frombuffer(r["q_bounds"], float).copy() if r["q_bounds"] is not None else np.full(len(mine), -np.inf)
                    upto = np.frombuffer(r["q_upto"], np.int64).copy() if r["q_upto"] is not None else np.zeros(len(mine), np.int64)
                    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(mine)
                if r["block"] != last:
                    last, bucket = r["block"], Bucket(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, dims))
                for i, own in enumerate(mine.tolist()):
                    ids, scores = bucket.best(queries[i], own, k, bounds[i], int(upto[i]))
                    if not len(ids):
                        continue
                    ids, scores = np.concatenate([found[i][0], ids]), np.concatenate([found[i][1], scores])
                    order = np.lexsort((ids, -scores))[:k]
                    found[i] = ids[order], scores[order]
                    if len(order) == k:
                        bounds[i], upto[i] = found[i][1][-1], found[i][0][-1]
        if found:
            yield made()

    return run


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, bucket: int = 4096, block: int = 512,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query.

    Queries are the rows where ``is_query`` (over id_col) holds; candidates are
    all rows with another id; ties go to the smaller id. Vectors that are null
    or hold a null or non-finite component, and rows with a null id, take no
    part. Of rows that repeat an id the smallest vector counts. A vector shorter
    than others is padded by zeros, an empty one is all zeros. Components so large
    that a product could pass a long's range are an error, which names them. An
    empty table gives an empty one. Other columns of ``vectors`` are not read.

    Buckets and blocks of queries meet in a grid: a pair is one row that holds
    at most ``bucket`` vectors and ``block`` queries. A pass over the longest
    vectors gives each query its bound, and pairs that can't reach it are left
    out before they are made.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    rows = staged(clean.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    far = F.array_max(F.transform("v", lambda x: F.abs(x.cast("decimal(20,0)"))))
    dims, count, largest = rows.agg(F.max(F.size("v")), F.count("*"), F.max(far)).first()
    dims, parts = dims or 0, max(1, -(-count // (16 * bucket)))
    if dims * int(largest or 0) ** 2 >= 1 << 63:
        raise ValueError(f"{dims} components of up to {largest} can have a product beyond a long")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    along = rows.withColumn("norm", norm).repartitionByRange(parts, F.col("norm").desc(), F.col("id")).sortWithinPartitions(F.col("norm").desc(), "id")
    buckets = staged(along.select("id", "v").mapInArrow(_blocks(bucket, dims), BLOCK), "buckets")
    # blocks by length too: queries of like length have bounds and limits alike
    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id").withColumn("norm", norm)
    asked = asked.repartitionByRange(parts, F.col("norm").desc(), F.col("id")).sortWithinPartitions(F.col("norm").desc(), "id")
    queries = staged(asked.select("id", "v").mapInArrow(_blocks(block, dims), BLOCK), "queries").selectExpr("block as q_block", "longest as q_longest", "ids as q_ids", "vectors as q_vectors")
    # the longest vectors, a bucket's worth of them, give each query its bound
    longest = buckets.select("block", "rows").orderBy("block").limit(bucket).collect()  # numbers of at most a bucket's rows
    none = "query_id long, vec_id long, score long"
    if not longest:
        return clean.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = np.cumsum([r.rows for r in longest])
    last = longest[min(int(np.searchsorted(held, bucket)), len(held) - 1)].block
    lead = buckets.where(F.col("block") <= last)  # fewer than two buckets' rows
    head = queries.join(F.broadcast(lead), F.lit(True)).withColumn("q_bounds", F.lit(None).cast("binary")).withColumn("q_upto", F.lit(None).cast("binary"))
    start = staged(_ranked(head.mapInArrow(_search(k), none), k), "first")
    kth = F.max(F.struct("rank", "score", "vec_id"))
    bounds = start.groupBy("query_id").agg(kth.alias("x")).where(F.col("x.rank") == k).select("query_id", F.col("x.score").alias("low"), F.col("x.vec_id").alias("upto"))
    queries = staged(_bounded(queries, bounds), "bounded")
    # the grid: each block of queries goes to every lane, each bucket lies in one
    rest = buckets.where(F.col("block") > last).select("block").distinct().count()
    lanes = max(1, min(rest, int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
    spread = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # queries are the streamed side, so that the pairs of a block of them come together; neither side is broadcast,
    # since both grow with the input and are several times larger than their tables on disk
    met = spread.join(buckets.where(F.col("block") > last).withColumn("lane", lane).hint("merge"), "lane").where(F.col("longest") * F.col("q_longest") * (1 + 1e-9) >= F.col("q_least"))
    rest = met.mapInArrow(_search(k), none)
    return _ranked(start.select("query_id", "vec_id", "score").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _bounded(queries: DataFrame, bounds: DataFrame) -> DataFrame:
    """Blocks of queries with each query's bound, and the least of them over the longest query."""
    ids = queries.select("q_block", F.posexplode(_longs("q_ids")).alias("at", "query_id"))
    low = F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("low")
    each = ids.join(bounds.hint("merge"), "query_id", "left").select("q_block", F.struct("at", low, F.coalesce("upto", F.lit(0).cast("long")).alias("upto")).alias("x"))
    packed = each.groupBy("q_block").agg(F.array_sort(F.collect_list("x")).alias("x")).select("q_block", F.col("x.low").alias("lows"), F.col("x.upto").alias("uptos"))
    out = queries.join(packed.hint("merge"), "q_block")
    return out.select("q_block", "q_longest", "q_ids", "q_vectors", _packed("lows", float).alias("q_bounds"), _packed("uptos", np.int64).alias("q_upto"), F.array_min("lows").alias("q_least"))


def _longs(column: str) -> Column:
    return F.arrow_udf(lambda a: pa.array([np.frombuffer(x, np.int64).tolist() for x in a.to_pylist()], pa.list_(pa.int64())), "array<long>")(F.col(column))


def _packed(column: str, kind: type) -> Column:
    return F.arrow_udf(lambda a: pa.array([np.array(x, kind).tobytes() for x in a.to_pylist()], pa.binary()), "binary")(F.col(column))
