"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.store import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on edges (a, b) with a > b."""
    both = edges
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the edges of a node with very many can be split over tasks
    low = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("m")), "low")
    joined = both.join(low, F.col("a") == F.col("k"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        kept = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = kept.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    ``edges`` has columns a and b of one orderable type, in any order and with
    repeats; rows with a null end and loops are dropped. Large-star and
    small-star steps alternate until the edges stay as they are. Each step is
    a written table, so lineage stays short. The rounds grow with the logarithm
    of the longest path; ``max_rounds`` only turns a fault into an error.
    """
    now = staged(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == sign or new[0] == 0:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        sign = tuple(new)
        now = staged(_star(staged(_star(now, True), "large"), False), "small")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
