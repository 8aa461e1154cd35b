"""Long panels, two-period comparison panels and period selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions import clip_nonneg, delta_fraction
from panelwright.sources import LONG_SCHEMA

PANEL_KEYS = ("category", "indicator", "unit")


def long_panel(df: DataFrame) -> DataFrame:
    """The canonical columns in canonical order. Sorting is left to the sink."""
    return df.select(*LONG_SCHEMA.fieldNames())


def drop_invalid(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Keep rows in which every required column is present and not empty text."""
    keep = F.lit(True)
    for name in required:
        keep = keep & F.col(name).isNotNull() & (F.col(name).cast("string") != "")
    return df.filter(keep)


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows with at least one of the values."""
    return df.dropna(how="all", subset=list(columns))


def replace_na(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def clip_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: clip_nonneg(c) for c in columns})


def period_filter(df: DataFrame, periods: Sequence[int], period: str = "period") -> DataFrame:
    """Rows of the given periods.

    On a stored period column the filter reaches the scan or prunes folders. A period computed from a
    date does not; give such a source a date range first.
    """
    return df.filter(F.col(period).isin(*periods))


def last_period(df: DataFrame, period: str = "period") -> Column:
    """The last period as a scalar subquery."""
    return df.agg(F.max(period)).scalar()


def latest_period(df: DataFrame, period: str = "period", seen_in: DataFrame | None = None) -> DataFrame:
    """Rows of the last period; they are not shuffled for it.

    ``seen_in``, here and elsewhere, is a table with the same periods that is cheaper to ask
    than ``df``, such as the source from which ``df`` was aggregated.
    """
    return df.filter(F.col(period) == last_period(df if seen_in is None else seen_in, period))


def lookup_scalar(
    df: DataFrame,
    match: Mapping[str, object],
    value: str = "value",
    default: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The one value whose row matches, else ``default`` when there is none, several or NULL.

    With ``by`` the lookup is made once per group; every group of ``df`` gets a row.
    """
    hit = F.lit(True)
    for name, wanted in match.items():
        hit = hit & F.coalesce(F.col(name) == F.lit(wanted), F.lit(False))
    found = F.count_if(hit)
    only = F.max(F.when(hit, F.col(value)))
    result = F.when((found == 1) & only.isNotNull(), only).otherwise(F.lit(default).cast("double"))
    return df.groupBy(*by).agg(result.alias(value)) if by else df.agg(result.alias(value))


def pivot_compare(
    df: DataFrame,
    base: int,
    current: int,
    keys: Sequence[str] = PANEL_KEYS,
    period: str = "period",
    value: str = "value",
    combine: str = "max",
) -> DataFrame:
    """One row per key with the values of two periods.

    Periods are given, so no job looks for them, and the conditional aggregates combine
    map-side, so a key that holds most rows costs no more than another. A key should
    have one row per period (see ``duplicate_keys``), and of several the largest is taken;
    ``combine="sum"`` builds the panel from unaggregated observations in the same pass.
    """
    both = period_filter(df, [base, current], period)
    merge = F.sum if combine == "sum" else F.max

    def at(p: int) -> Column:
        return merge(F.when(F.col(period) == p, F.col(value))).cast("double")

    return both.groupBy(*keys).agg(at(base).alias("value_base"), at(current).alias("value_current"))


def add_deltas(panel: DataFrame) -> DataFrame:
    """Absolute change, and relative change as a fraction."""
    base, current = F.col("value_base"), F.col("value_current")
    return panel.withColumns({
        "delta_abs": current - base,
        "delta_frac": delta_fraction(base, current),
    })


def comparison_panel(df: DataFrame, base: int, current: int, keys: Sequence[str] = PANEL_KEYS, **columns) -> DataFrame:
    return add_deltas(pivot_compare(df, base, current, keys, **columns))
