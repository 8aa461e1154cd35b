"""One registered query per operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import (
    exact, language, packing, pieces, pii, quality, secrets, simhash, spelling, token_files, toxicity,
    whitening, wordpiece,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_personal_data")
def op1(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op2_exact_duplicates", r"""
    WITH texts AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM texts WINDOW same AS (PARTITION BY t)
""")
def op2(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op4_word_pieces")
def op4(spark, sf_dir):
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"))


@query("op5_simhash_components")
def op5(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_packed_windows")
def op3(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op6_secrets", secrets.oracle_sql())
def op6(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_language")
def op10(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


@query("op11_whitened_embeddings")
def op11(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_token_files")
def op13(spark, sf_dir):
    return token_files.token_digests(table(spark, sf_dir, "documents"))
