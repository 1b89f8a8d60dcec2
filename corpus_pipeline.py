"""A corpus from raw documents to packed sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir); docs is what the stage before kept,
read back from Parquet. All but the last return the columns of documents;
other columns, whatever their names, end there. Texts are read whole at any
length, and an empty table passes all stages. Documents with a null id or a
null or empty text are clean; of the empty ones that have an id near-duplicates
keep the first, and the last stage packs an empty text as one token. What a stage decides for an id holds for all rows
that repeat it, but for decontamination, which decides by id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, near_copies, packing, secrets, simhash, toxicity
from skein.llm._store import staged, table
from skein.llm.queries import TOXIC, fold_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below the threshold; labels of one fold in four stay unseen. Null and empty texts stay."""
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), 4) != 2)
    lexicon = toxicity.fit_lexicon(docs, labels)
    return toxicity.score_toxicity(docs, lexicon, out="toxicity").where(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    First by fingerprints, which leaves few copies, then by five-word shingles
    that agree in four fifths or more. Of texts without words, linked by
    their equal fingerprint, one stays, and all of those with a null id.
    """
    first = staged(simhash.keep_first(docs).select(*COLUMNS), "fingerprinted")
    return near_copies.keep_first(first).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage makes up a twentieth of. Null and empty texts have no words and stay; rows with equal id and text go together."""
    keyed = docs.withColumn("key", F.xxhash64("text"))
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), carry=("key",))
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    same = keyed["doc_id"].eqNullSafe(gone["gone_id"]) & (keyed["key"] == gone["gone_key"])
    return keyed.join(gone, same, "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in them replaced; null texts stay null, and n_chars follows the text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact),
    ("packing", pack),
]

#: No SQL: the lexicon, XXH64 and the tokenizer are beyond it. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, with a written table between each two."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
