"""Metric tables and run metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def metrics_long(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A wide row of numbers as ``metric, value`` rows."""
    columns = list(columns or [c for c in df.columns if c not in by])
    typed = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(list(by), columns, "metric", "value")


def run_metadata(
    df: DataFrame,
    model: str,
    version: str,
    distinct: str,
    source: str,
    extra: Mapping[str, object] | None = None,
) -> DataFrame:
    """One row that describes a run: model, time, source, rows and distinct entities."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(distinct).alias("n_distinct"),
    ).select(
        F.lit(model).alias("model"),
        F.lit(version).alias("version"),
        F.lit(source).alias("source"),
        F.current_timestamp().alias("run_at"),
        "n_rows", "n_distinct",
        *[F.lit(value).alias(name) for name, value in (extra or {}).items()],
    )
