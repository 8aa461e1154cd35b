"""Growth decomposition of a two-period panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import presets
from panelwright.functions import band, clip_nonneg, finite_or_null
from panelwright.operators.concentration import inequality
from panelwright.operators.panel import drop_all_null


def growth_category(rate: Column) -> Column:
    return band(rate, presets.GROWTH_BANDS, presets.GROWTH_REST)


def contribution_category(part: Column) -> Column:
    return band(part, presets.CONTRIBUTION_BANDS, presets.CONTRIBUTION_REST)


def positive_growth(panel: DataFrame) -> DataFrame:
    """Rows with a value, plus ``delta_pos``: growth above zero, NULL without both periods."""
    return drop_all_null(panel, ["value_base", "value_current"]).withColumn("delta_pos", clip_nonneg("delta_abs"))


def growth_decomposition(panel: DataFrame) -> DataFrame:
    """Contribution of each indicator to total growth and to the current level.

    Both totals are one scalar subquery, so rows are neither shuffled nor joined.
    """
    rows = positive_growth(panel)
    totals = rows.agg(F.struct(
        F.sum("delta_pos").alias("growth"), F.sum("value_current").alias("stock"),
    ))
    return rows.withColumn("totals", totals.scalar()).withColumns({
        "growth_rate": F.col("delta_frac"),
        "contrib_growth": F.try_divide("delta_pos", "totals.growth"),
        "contrib_stock": F.try_divide("value_current", "totals.stock"),
    }).withColumns({
        "growth_category": growth_category(F.col("growth_rate")),
        "contrib_category": contribution_category(F.col("contrib_growth")),
    }).drop("totals")


def top_contributors(decomposition: DataFrame) -> DataFrame:
    """Indicators that grew. Order by ``contrib_growth`` descending when writing them."""
    return decomposition.filter(F.col("delta_pos") > 0)


def growth_metrics(panel: DataFrame, fractions: Sequence[float] = (0.20, 0.50)) -> DataFrame:
    """One row: Gini and top shares of positive growth, total and net growth, indicators."""
    rows = positive_growth(panel)
    sums = rows.agg(
        F.coalesce(F.sum("delta_pos"), F.lit(0.0)).alias("total_growth_pos"),
        F.coalesce(F.sum(finite_or_null("delta_abs")), F.lit(0.0)).alias("total_growth_net"),
        F.count(F.lit(1)).cast("double").alias("n_indicators"),
    )
    spread = inequality(rows, "delta_pos", fractions)
    return sums.withColumn("spread", spread.select(F.struct(*spread.columns)).scalar()).select(
        F.col("spread.gini").alias("gini_growth_pos"),
        *[F.col(f"spread.{c}").alias(f"pareto_{c}_pos") for c in spread.columns if c != "gini"],
        "total_growth_pos", "total_growth_net", "n_indicators",
    )
