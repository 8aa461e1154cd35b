"""What the operators share: the row contract, folds, worker set-up and intermediate tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.sources import durable, scratch_path

__all__ = ["SPACE", "documents", "durable", "fold", "package_on_workers", "scratch_path", "stored", "vocabulary_file"]

#: White space as every contract here counts it: the blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty, plus the named columns.

    Other columns are left out here, so columns of any name may come along in ``docs``.
    """
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in columns],
    )


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)).cast("int")


def package_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is shipped with the job (``--py-files``); this only adds the
    driver's own folder to the workers' search path, for sessions started elsewhere.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def vocabulary_file(name: str) -> str:
    """Place of a public vocabulary file on this machine; a path stays as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
