"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's fingerprints are the hashes of its runs of ``gram`` words, of which
winnowing keeps the smallest in every sliding window of ``window - gram + 1``
runs. Two texts that share ``window`` words share the smallest hash of those
words, so joining fingerprints misses no shared span of that length. A hit is
then extended to the windows around it, which must equal a benchmark window
word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm._store import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _runs(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, by start."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n))))


def _winnowed(words: Column, runs: Column, window: int, gram: int, lengths: list[int]) -> Column:
    """(hash, m): the smallest of each ``window`` - ``gram`` + 1 consecutive ``runs``, with m = ``window``, and all runs
    of the lengths m of short items; each hash once, none from too few words."""
    span, none = window - gram + 1, F.expr("CAST(array() AS array<struct<hash:bigint,m:int>>)")
    least = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(runs) - span + 1), lambda i: F.array_min(F.slice(runs, i, span))))
    parts = [F.when(F.size(words) >= window, F.transform(least, lambda x: F.struct(x.alias("hash"), F.lit(window).alias("m")))).otherwise(none)]

    def every(n: int) -> Column:
        found = F.transform(F.array_distinct(_runs(words, n)), lambda x: F.struct(x.alias("hash"), F.lit(n).alias("m")))
        return F.when(F.size(words) >= n, found).otherwise(none)

    return F.concat(*parts, *map(every, lengths))


def _placed(words: Column, runs: Column, window: int, lengths: list[int]) -> Column:
    """(hash, m, at) of all runs that ``_winnowed`` chooses from."""
    none = F.expr("CAST(array() AS array<struct<hash:bigint,m:int,at:int>>)")

    def every(runs: Column, m: int) -> Column:
        return F.when(F.size("w") >= m, F.transform(runs, lambda x, i: F.struct(x.alias("hash"), F.lit(m).alias("m"), i.alias("at")))).otherwise(none)

    return F.concat(every(runs, window), *[every(_runs(words, n), n) for n in lengths])


def _windows(benchmark: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(hash, m, text, items): the benchmark windows of m words, the fingerprint of each and the items that hold it.

    A window of an item shorter than ``window`` stands under the hash of the
    whole of it.
    """
    items = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0 and item is not null")
    long = items.where(F.size("w") >= window).select(
        "item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.slice("w", i, window))).alias("w")
    )
    runs = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(window - gram + 1)), lambda i: F.xxhash64(F.slice(F.transform("w", lambda x: F.xxhash64(x)), i, gram))))
    short = items.where(F.size("w") < window)
    whole = F.xxhash64(F.transform("w", lambda x: F.xxhash64(x)))
    both = long.select("item", F.array_join("w", " ").alias("text"), F.lit(window).alias("m"), runs.alias("hash")).unionByName(
        short.select("item", F.array_join("w", " ").alias("text"), F.size("w").alias("m"), whole.alias("hash"))
    )
    return both.groupBy("hash", "text", "m").agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 6, share: int = 20, broadcast_rows: int = 200_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: id_col, n_words, n_hit, items, contaminated, and the columns of ``carry``.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter item; a document word inside an occurrence of a window is hit.
    ``items`` are the sorted ids of the items with an occurring window. A row is
    contaminated if it has a hit and ``share`` times the hits reach its words.
    Null and empty texts have no words and no hits. Repeated rows and null ids
    are rows of their own; items with a null id are left out, and items that
    repeat an id count as one. An empty benchmark hits nothing, an empty table
    gives an empty one. Texts are read whole; the work grows with their length.
    Other columns than those named aren't read, whatever their names.

    The numbered rows are written first, since they are read three times: for
    all fingerprints, for the places of those that the benchmark holds, and for
    the words around these places. The last two read rows with a fingerprint in
    common only. Up to ``broadcast_rows`` benchmark fingerprints, two numbers
    each, are broadcast; more are joined by a shuffle.
    """
    index = staged(_windows(benchmark, item_col, item_text_col, window, gram), "windows")
    lengths = sorted(r.m for r in index.select("m").where(F.col("m") < window).distinct().collect())  # fewer than window
    known = staged(index.select(F.col("hash").alias("known"), F.col("m").alias("of")).distinct(), "fingerprints")
    small = known.count() <= broadcast_rows
    carried = [F.struct(*carry).alias("carried")] if carry else []
    held = ["carried"] if carry else []
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *carried, F.col(text_col).alias("text")), "rows")

    def worded(of: DataFrame) -> DataFrame:
        return of.withColumn("w", words_of(F.col("text"))).withColumn("h", F.when(F.size("w") >= window, _runs(F.col("w"), gram)))

    # an entry of each document without a hash keeps documents without a match
    nothing = F.struct(F.lit(None).cast("long").alias("hash"), F.lit(0).alias("m"))
    prints = F.concat(_winnowed(F.col("w"), F.col("h"), window, gram, lengths), F.array(nothing))
    each = worded(rows).select("row", "id", *held, F.size("w").alias("n_words"), F.explode(prints).alias("f"))
    same = (F.col("f.hash") == F.col("known")) & (F.col("f.m") == F.col("of"))
    met = staged(each.join(F.broadcast(known) if small else known, same, "left").where("known is not null or f.m = 0"), "met")
    every = met.where("f.m = 0").select("row", "id", *held, "n_words")
    shared = staged(met.where("f.m > 0").select("row", "f.hash", "f.m"), "shared")

    # places of the shared fingerprints, then the windows that may lie around them
    again = worded(rows.select("row", "text").join(shared.select("row").distinct(), "row")).select("row", F.size("w").alias("n"), F.explode(_placed(F.col("w"), F.col("h"), window, lengths)).alias("p"))
    at = again.select("row", "n", "p.hash", "p.m", "p.at").join(shared, ["row", "hash", "m"])
    first = F.when(F.col("m") < window, F.col("at")).otherwise(F.greatest(F.lit(0), F.col("at") - (window - gram)))
    starts = at.select("row", "m", F.explode(F.sequence(first, F.least("at", F.col("n") - F.col("m")))).alias("s")).groupBy("row").agg(F.collect_set(F.struct("s", "m")).alias("starts"))
    starts = staged(starts, "starts")
    texts = rows.select("row", "text").join(starts, "row").withColumn("w", words_of(F.col("text")))
    cut = F.transform("starts", lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), F.array_join(F.slice("w", x["s"] + 1, x["m"]), " ").alias("text")))
    windows = texts.select("row", F.explode(cut).alias("x")).select("row", "x.s", "x.m", "x.text")
    found = windows.join(index.select("m", "text", "items"), ["m", "text"]).groupBy("row").agg(F.collect_set(F.struct("s", "m")).alias("at"), F.collect_set("items").alias("sets"))

    # the windows' words, overlaps once
    merged = F.aggregate(
        F.array_sort("at"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("hit")),
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["s"] + x["m"]).alias("upto"),
            (a["hit"] + F.greatest(F.lit(0), x["s"] + x["m"] - F.greatest(a["upto"], x["s"]))).alias("hit"),
        ),
    )["hit"]
    hits = staged(found.select(F.col("row").alias("hit_row"), merged.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items")), "hits")
    out = every.join(hits, F.col("row") == F.col("hit_row"), "left")
    none = F.array().cast(hits.schema["items"].dataType)
    out = out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), *(["carried.*"] if carry else []))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def items_digest(items: Column) -> Column:
    """SHA-256 of the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)
