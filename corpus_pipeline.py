"""From raw documents to training windows, in stages that each keep the columns of documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next one's docs. Rows that agree in id and text count as one document for dropping copies, so a
repeated row does not survive as its own duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import exact, language, packing, pii, simhash
from panelwright.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _id_key():
    """A null id as text of its own, so that it joins with itself."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _matching(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text hash are in ``chosen`` (doc_id, text_xxh64), one for each pair."""
    pairs = chosen.select(_id_key().alias("id_key"), "text_xxh64").distinct()
    keyed = _documents(docs).withColumn("id_key", _id_key()).withColumn("text_xxh64", _text_hash())
    return keyed.join(pairs, ["id_key", "text_xxh64"]).dropDuplicates(["id_key", "text_xxh64"]).select(*COLUMNS)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set ``lang`` to the predicted language; documents without a letter go.

    Every row is judged by its own text; repeated rows stay.
    """
    model = language.fit(docs)
    return language.with_language(_documents(docs), model).filter(F.col("lang") != language.UNKNOWN)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the smallest id."""
    kept = exact.exact_duplicates(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    keyed = _documents(docs).withColumn("id_key", _id_key()).withColumn(
        "sha", F.sha2(exact.normalised(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))
    pairs = kept.select(_id_key().alias("id_key"), "sha").distinct()
    return keyed.join(pairs, ["id_key", "sha"]).dropDuplicates(["id_key", "sha"]).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Near copies have fingerprints of three-word shingles that differ in two bits or fewer, or are
    linked by a chain of such documents. Documents without a word share one fingerprint.
    """
    groups = simhash.near_duplicates(docs, words=simhash.WORDS, radius=simhash.RADIUS)
    return _matching(docs, groups.filter("kept"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the kind in brackets over every span of personal data; ``n_chars`` follows the text."""
    masked = pii.masked(_documents(docs))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in windows of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", detect_language),
    ("exact", drop_exact),
    ("near", drop_near),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]
#: The fingerprints, the learned span classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
