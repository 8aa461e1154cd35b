"""Concentration indices: HHI, effective competitors, CR-k, Gini, Palma, Pareto shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import presets
from panelwright.functions import band
from panelwright.operators.panel import latest_period
from panelwright.operators.ranking import Grouping, group_places, measure, top_k_per_group, top_values, value_ranks


def _per_group(df: DataFrame, by: Sequence[str], value: str, *indices: Column) -> DataFrame:
    """The grouping columns and the given aggregates over each group's value ranks."""
    groups = Grouping(df, by)
    table = value_ranks(df, groups, value).groupBy(*groups.names).agg(*indices)
    return table.select(*groups.restored, *[c for c in table.columns if c not in groups.names])


def _taken(first: Column, last: Column) -> Column:
    """How many of a value's rows have a place, counted from the largest, in [first, last]."""
    start, stop = F.col("above_rows") + 1, F.col("above_rows") + F.col("rows")
    inside = F.least(stop, last) - F.greatest(start, first) + 1
    return F.when(inside > 0, inside).otherwise(F.lit(0))


def _mass_in(first: Column, last: Column) -> Column:
    return F.sum(F.col("x") * _taken(first, last))


def _top_mass(k: Column) -> Column:
    return _mass_in(F.lit(1), k)


def _n() -> Column:
    return F.max("group_rows")


def _mass() -> Column:
    return F.max("group_mass")


def _gini() -> Column:
    """From the ascending places of each value's rows: 2·Σ place·x / (n·Σx) − (n+1)/n."""
    # In doubles: rows times places exceeds a bigint from some billions of equal rows on.
    rows, last = F.col("rows").cast("double"), (F.col("group_rows") - F.col("above_rows")).cast("double")
    places = rows * last - rows * (rows - 1) / 2
    weighted = F.sum(F.col("x") * places)
    return F.when(_mass() <= 0, F.lit(0.0)).otherwise(2 * weighted / (_n() * _mass()) - (_n() + 1) / _n())


def _palma() -> Column:
    """Top tenth (at least one row) over the rows from place ceil(0.6 n) on."""
    n = F.col("group_rows")
    top = _top_mass(F.greatest(F.lit(1), F.floor(n * F.lit(0.10))))
    bottom = _mass_in(F.ceil(n * F.lit(0.60)), n)
    return F.when(_mass() > 0, F.try_divide(top, bottom))


def _hhi() -> Column:
    part = F.try_divide("x", "group_mass")
    return F.when(_mass() > 0, F.sum(F.col("rows") * part * part) * 10000)


def _cr(k: int, ties: str, empty: float | None) -> Column:
    """Share in percent of the largest: all rows of the k largest values, or exactly k rows."""
    if ties == "dense":
        top = F.sum(F.when(F.col("above_values") < k, F.col("rows") * F.col("x")).otherwise(F.lit(0.0)))
    else:
        top = _top_mass(F.lit(k))
    return F.when(_mass() > 0, top / _mass() * 100).otherwise(F.lit(empty).cast("double"))


def hhi(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Σ share² × 10000 by one two-phase aggregation, without ranks or a second pass."""
    x = measure(value)
    total, squares = F.sum(x), F.sum(x * x)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"),
        total.alias("total"),
        F.when(total > 0, squares / (total * total) * 10000).alias("hhi"),
    )


def effective_n(hhi_column: Column) -> Column:
    return F.when(hhi_column > 0, 10000 / hhi_column)


def gini(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient per group; zero when nothing is positive."""
    groups = Grouping(df, by)
    n, mass = F.col("rows").cast("double"), F.col("mass")
    # Places from the smallest up are n + 1 less places from the largest down.
    ascending = (n + 1) * mass - F.col("placed")
    index = F.when(mass <= 0, F.lit(0.0)).otherwise(2 * ascending / (n * mass) - (n + 1) / n)
    return group_places(df, groups, value).select(*groups.restored, index.alias("gini"))


def palma(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Share of the top tenth over the share of the lower part, per group."""
    return _per_group(df, by, value, _palma().alias("palma"))


def concentration_ratios(
    df: DataFrame, by: Sequence[str], value: str, ks: Sequence[int] = (3, 5), ties: str = "dense"
) -> DataFrame:
    """CR-k per group. ``dense``: all rows of the k largest values; ``row``: exactly k rows.

    Nothing is ranked beyond the largest k: tasks keep their own k values or rows of each group.
    """
    groups, most, x = Grouping(df, by), max(ks), F.col("_x")
    if ties == "dense":
        top, empty = top_values(df, by, value, most), 0.0
        mass = F.col("x") * F.col("rows")
    else:
        rows = df.select(*groups.selected(), measure(value).alias("_x")).filter(x.isNotNull())
        top, empty = top_k_per_group(rows, groups.names, [x.desc()], most), None
        mass = x
    largest = top.groupBy(*groups.names).agg(
        *[F.sum(F.when(F.col("place") <= k, mass)).alias(f"top{k}") for k in ks])
    totals = df.select(*groups.selected(), measure(value).alias("_x")).groupBy(*groups.names).agg(F.sum("_x").alias("total"))
    total = F.col("total")
    return largest.join(totals, groups.names).select(*groups.restored, *[
        F.when(total > 0, F.col(f"top{k}") / total * 100).otherwise(F.lit(empty).cast("double")).alias(f"cr{k}")
        for k in ks])


def inequality(df: DataFrame, value: str, fractions: Sequence[float]) -> DataFrame:
    """One row: the Gini coefficient and, per fraction ``p``, the share of the sum held by the
    top ``ceil(p·n)`` rows.

    ``n`` counts all rows, also those without a value.
    """
    ranks = value_ranks(df, Grouping(df, []), value).withColumn("all_rows", df.agg(F.count(F.lit(1))).scalar())
    columns = [_gini().alias("gini")]
    for p in fractions:
        k = F.greatest(F.lit(1), F.ceil(F.col("all_rows") * F.lit(p)))
        columns.append(F.try_divide(_top_mass(k), _mass()).alias(f"top{round(p * 100)}"))
    return ranks.agg(*columns)


def top_share(df: DataFrame, value: str, fractions: Sequence[float]) -> DataFrame:
    """The top shares of ``inequality`` alone."""
    return inequality(df, value, fractions).drop("gini")


def hhi_category(c: Column) -> Column:
    return band(c, presets.HHI_CATEGORIES, presets.HHI_CATEGORY_REST, keep_null=True)


def hhi_implication(c: Column, variant: str = "indicator") -> Column:
    if variant == "actor":
        return band(c, presets.ACTOR_HHI_IMPLICATIONS, presets.ACTOR_HHI_IMPLICATION_REST, keep_null=True)
    return band(c, presets.HHI_IMPLICATIONS, presets.HHI_IMPLICATION_REST, keep_null=True)


def concentration_indices(
    df: DataFrame, by: Sequence[str], value: str, ties: str = "dense", variant: str = "indicator"
) -> DataFrame:
    """All indices of each group from one pass over its value ranks."""
    empty = 0.0 if ties == "dense" else None
    indices = _per_group(
        df, by, value,
        _n().alias("n"),
        _mass().alias("total"),
        _hhi().alias("hhi"),
        _cr(3, ties, empty).alias("cr3"),
        _cr(5, ties, empty).alias("cr5"),
        _gini().alias("gini"),
        _palma().alias("palma"),
    )
    level = F.col("hhi")
    return indices.select(
        *by, "n", "total", "hhi", effective_n(level).alias("effective_n"),
        "cr3", "cr5", "gini", "palma",
        hhi_category(level).alias("hhi_category"),
        hhi_implication(level, variant).alias("implication"),
    )


def label_markets(df: DataFrame, labels: dict[str, str], market: str = "market") -> DataFrame:
    """Add a display label; a market without one keeps its name."""
    label = F.col(market)
    for name, text in labels.items():
        label = F.when(F.col(market) == name, F.lit(text)).otherwise(label)
    return df.withColumn("market_label", label)


def hhi_trend(indices: DataFrame, by: Sequence[str] = ("market",), period: str = "period") -> DataFrame:
    """Change of the HHI since the previous period of the same market.

    The input has one row per market and period, so the window is as long as the periods.
    """
    previous = F.lag("hhi").over(Window.partitionBy(*by).orderBy(period))
    return indices.withColumn("hhi_trend", F.col("hhi") - previous)


def entry_barriers(indices: DataFrame, period: str = "period", seen_in: DataFrame | None = None) -> DataFrame:
    """Entry-barrier level and its meaning, from the HHI of the last period."""
    level = band(F.col("hhi"), presets.ENTRY_BARRIERS, presets.ENTRY_BARRIER_REST)
    text = F.lit(presets.BARRIER_TEXT[presets.ENTRY_BARRIER_REST])
    for name, meaning in presets.BARRIER_TEXT.items():
        text = F.when(F.col("barrier") == name, F.lit(meaning)).otherwise(text)
    return (
        latest_period(indices, period, seen_in)
        .withColumn("barrier", level)
        .withColumn("barrier_implication", text)
    )


def hhi_range(indices: DataFrame, digits: int = 3) -> DataFrame:
    low, high = (F.round(f("hhi"), digits).cast("string") for f in (F.min, F.max))
    return indices.agg(F.concat_ws("-", low, high).alias("hhi_range"))
