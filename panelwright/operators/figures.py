"""Tables behind the charts. Global top-k is a per-task top-k and one merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.functions import signed_label, truncate_label


def top_movers(decomposition: DataFrame, keys: Sequence[str], k: int = 12) -> DataFrame:
    """The ``k`` largest changes in either direction, with a signed label."""
    return (
        decomposition.withColumn("abs_delta", F.abs("delta_abs"))
        .orderBy(F.col("abs_delta").desc_nulls_last(), *keys)
        .limit(k)
        .select(*keys, "delta_abs", "delta_pos", "abs_delta", signed_label(F.col("delta_abs")).alias("label"))
    )


def top_index(table: DataFrame, keys: Sequence[str], index: str = "composite", k: int = 12) -> DataFrame:
    return table.orderBy(F.col(index).desc_nulls_last(), *keys).limit(k).select(*keys, index)


def score_bars(components: DataFrame, entity: Sequence[str] = (), width: int = 28) -> DataFrame:
    """Shortened names and scores. Order by ``weighted_score`` ascending when drawing."""
    return components.select(*entity, "code", truncate_label(F.col("name"), width).alias("label"), "weighted_score")
