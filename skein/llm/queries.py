"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, html_text, language_model, packing, retrieval, secrets, simhash, sql, substrings, toxicity, url_filter, url_lists
from skein.llm._store import table

#: A document scores as toxic from here on.
TOXIC = 0.3


def fold_of(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n)).cast("int")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents. A null or empty text is the one id 0, a repeated row a document of its own; texts of any length
    are cut into as many pieces as they need. Equal curve keys are ordered by id. No documents give no rows."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of every twentieth vector. Vectors that are null or hold a null or non-finite component take no part, of rows
    that repeat an id the smallest vector counts, ties go to the smaller id. No vectors give no rows."""
    return retrieval.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. A null, empty or text-less page has an empty one; pages of any length are read whole;
    repeated rows are rows of their own; of equal containers the first wins. No pages give no rows."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every document. Null and empty texts have no words; repeated rows and null ids are rows of their own; an item with
    a null id is left out. Long texts are read whole. No documents give no rows, no items no hits."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document. Null and empty texts have none; a repeated row repeats all its windows, whichever is first:
    all occurrences go alike. Long texts are read whole. No documents give no rows."""
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every row. Null and empty texts score as texts without a match, repeated rows alike; null labels aren't learnt
    from, and of several labels of a document a toxic one counts. Long texts are read whole. No documents give no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    lexicon = toxicity.fit_lexicon(docs, labels.where(~held_out))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), lexicon, out="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL on its date. A null URL or one without a host is matched by nothing; of equal keys block
    precedes allow; repeated rows are rows of their own. No pages give no rows."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.evaluate(url_lists.captures(pages), url_lists.entries(pages), carry=("page_id",))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every row. A null or empty text is the end token alone; repeated rows and null ids are rows of their
    own; long texts are scored whole, their state carried on. No documents give no rows."""
    held_out = fold_of(F.col("doc_id"), 5) == 1
    scored = language_model.fit_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row. Texts without words have fingerprint zero and are linked like others; repeated
    rows are rows of their own, null ids no component's smallest. Long texts are read whole. No documents give no rows."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every row. Null and empty texts have none; repeated rows are rows of their own; spans that start alike go by kind,
    then by end. Long texts are read whole. No documents give no rows."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), out="s")
    base = F.filter("s", lambda x: x["kind"].isin("assign", "access", "hex"))

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.span_digest(base), 256).alias("base_sha256"), secrets.span_digest(F.col("s")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_packing, op2_top_k, op3_main_text, op4_decontamination, op5_substrings,
        op6_toxicity, op7_url_filters, op8_language_model, op9_simhash, op10_secrets,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": sql.TOP_K, "op4_decontamination": sql.DECONTAMINATION, "op5_substrings": sql.SUBSTRINGS, "op7_url_filters": url_lists.SQL}
