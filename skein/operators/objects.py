"""Canonical ids of named objects from a registry of synonyms."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.python import similarity

FUZZY = 0.9
#: Pieces of synonyms that are broadcast; of more, names and pieces meet by a shuffle.
PIECES = 100_000


def registry(spark: SparkSession, objects: dict[str, list[str]]) -> DataFrame:
    """(synonym_norm, object_id, ord) of a configured registry; of equal synonyms the last one's id counts, in the first one's place."""
    place: dict[str, int] = {}
    owner: dict[str, str] = {}
    for object_id, synonyms in objects.items():
        for s in synonyms:
            k = s.lower().strip()
            place.setdefault(k, len(place))
            owner[k] = object_id
    rows = [(k, owner[k], place[k]) for k in owner]
    return spark.createDataFrame(rows, "synonym_norm string, object_id string, ord int")


def load_registry(spark: SparkSession, path: str | Path) -> DataFrame:
    """``registry`` of a YAML file: ids with their lists of synonyms, below ``objects`` or at the top."""
    import yaml  # optional: only a registry in a file needs it

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    found = found.get("objects", found)
    return registry(spark, {k: [str(s) for s in (v.get("synonyms", []) if isinstance(v, dict) else v or [])] for k, v in found.items()})


def _pieces(text: Column) -> Column:
    """A synonym cut into one piece more than a similar name can differ from it by characters left out or put in.

    A name of a similarity of FUZZY differs by a tenth of both lengths at most,
    which is two ninths of the synonym's, and a difference spoils one
    piece, so the name holds one of them whole.
    """
    size = F.length(text)
    n = F.floor(size * 2 / 9).cast("int") + 1
    at = lambda i: F.floor(i * size / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, at(i) + 1, at(i + 1) - at(i)))


def canonicalize(names: DataFrame, objects: DataFrame, name_col: str = "object_name_raw", out: str = "object_id") -> DataFrame:
    """``names`` with ``out``: the id of the equal synonym, else of the most similar one at FUZZY or more, else null.

    Each distinct name is looked up once. A similar pair has lengths within
    10/11 of each other and shares a piece of the synonym, so names and synonyms meet by those; of equally
    similar synonyms the first counts. Names are never broadcast, however small their table is on disk.
    """
    norm = F.trim(F.lower(F.col(name_col)))
    distinct = names.select(norm.alias("n")).where(F.col("n") != "").distinct()
    exact = distinct.join(objects.select(F.col("synonym_norm").alias("n"), F.col("object_id").alias("exact_id")), "n", "left")
    cut = objects.where("synonym_norm <> ''").select("synonym_norm", F.col("object_id").alias("near_id"), "ord", F.explode(_pieces(F.col("synonym_norm"))).alias("piece"))
    lengths = cut.groupBy(F.length("piece").alias("size")).agg(F.count("*").alias("n")).collect()  # lengths of pieces: a few
    sizes = [r.size for r in lengths]
    rest = exact.where("exact_id is null").select("n")
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.length("n") - k + 1), lambda i: F.substr("n", i, F.lit(k)))
    some = [F.when(F.length("n") >= k, grams(k)).otherwise(F.array().cast("array<string>")) for k in sizes]
    held = rest.select("n", F.explode(F.array_distinct(F.concat(*some) if some else F.array().cast("array<string>"))).alias("piece"))
    like = (F.length("n") * 9 <= F.length("synonym_norm") * 11) & (F.length("synonym_norm") * 9 <= F.length("n") * 11)
    met = held.join(cut.hint("broadcast" if sum(r.n for r in lengths) <= PIECES else "merge"), "piece").where(like).select("n", "synonym_norm", "near_id", "ord").distinct()
    scored = met.withColumn("s", similarity(F.col("n"), F.col("synonym_norm"))).where(F.col("s") >= FUZZY)
    best = Window.partitionBy("n").orderBy(F.col("s").desc(), "ord")
    near = scored.withColumn("k", F.row_number().over(best)).where("k = 1").select("n", "near_id")
    found = exact.join(near.hint("merge"), "n", "left").select("n", F.coalesce("exact_id", "near_id").alias("_found")).where("_found is not null")
    return names.drop(out).withColumn("n", norm).join(found.hint("merge"), "n", "left").withColumnRenamed("_found", out).drop("n")


def synonyms_of(objects: DataFrame, object_id: str) -> DataFrame:
    return objects.where(F.col("object_id") == object_id).select("synonym_norm")


def object_ids(objects: DataFrame) -> DataFrame:
    return objects.select("object_id").distinct()
