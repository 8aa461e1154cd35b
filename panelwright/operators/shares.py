"""Markets, shares, ranks and how they move between periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import presets
from panelwright.functions import band, clip_nonneg, finite_or_null, share
from panelwright.operators.panel import latest_period
from panelwright.operators.ranking import Grouping, attach_ranks, measure, top_k_per_group, value_ranks

INDICATOR_MARKETS = ("stock_base", "stock_current", "growth_pos")
ACTOR_MARKETS = ("total", "armed", "support")


def indicator_measures(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both levels and the positive change of each indicator, missing as zero."""
    def level(name: str) -> Column:
        return clip_nonneg(F.coalesce(finite_or_null(name), F.lit(0.0)))

    return panel.select(
        *keys,
        level("value_base").alias("stock_base"),
        level("value_current").alias("stock_current"),
        level("delta_abs").alias("growth_pos"),
    )


def unpivot_markets(df: DataFrame, keys: Sequence[str], markets: Sequence[str]) -> DataFrame:
    """One row per entity and market."""
    typed = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in markets])
    return typed.unpivot(list(keys), list(markets), "market", "capacity")


def indicator_markets(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The comparison panel as three markets."""
    return unpivot_markets(indicator_measures(panel, keys), keys, INDICATOR_MARKETS)


def share_bucket(rank: Column, rules=presets.SHARE_BUCKETS) -> Column:
    return band(rank, rules, presets.SHARE_REST)


def market_shares(df: DataFrame, by: Sequence[str], value: str = "capacity", ties: str = "dense") -> DataFrame:
    """Total, share, rank and bucket of every row inside its market.

    ``dense`` ranks count distinct values, ``min`` ranks count rows. An empty market has
    shares of zero, all ranked first.
    """
    ranked = attach_ranks(df, by, value)
    above = F.col("ranks.above_values") if ties == "dense" else F.col("ranks.above_rows")
    rules = presets.SHARE_BUCKETS if ties == "dense" else presets.ACTOR_SHARE_BUCKETS
    return (
        ranked.withColumns({
            "total_market": F.col("ranks.group_mass"),
            "share": share(F.col("ranks.x"), F.col("ranks.group_mass")),
            "rank": (above + 1).cast("bigint"),
        })
        .drop("ranks")
        .withColumn("bucket", share_bucket(F.col("rank"), rules))
    )


def plain_shares(df: DataFrame, by: Sequence[str], value: str = "capacity") -> DataFrame:
    """Total and share of every row inside its market, without ranks: totals are summed and joined back."""
    groups = Grouping(df, by)
    totals = df.select(*groups.selected(), measure(value).alias("_x")).groupBy(*groups.names).agg(
        F.sum("_x").alias("total_market"))
    return df.withColumns(groups.columns).join(totals, groups.names).select(
        *df.columns, "total_market", share(measure(value), F.col("total_market")).alias("share"))


def bucket_totals(df: DataFrame, by: Sequence[str], value: str = "capacity", ties: str = "dense") -> DataFrame:
    """Rows ``n`` and sum of ``value`` of each bucket of each market, from the ranks of values alone."""
    groups = Grouping(df, by)
    rules = presets.SHARE_BUCKETS if ties == "dense" else presets.ACTOR_SHARE_BUCKETS
    rank = F.col("above_values") + 1 if ties == "dense" else F.col("least_rank")
    ranks = value_ranks(df, groups, value)
    if ties != "dense":
        ranks = ranks.withColumn("least_rank", F.min("above_rows").over(Window.partitionBy(*groups.names, "x")) + 1)
    counted = ranks.groupBy(*groups.names, share_bucket(rank, rules).alias("bucket")).agg(
        F.sum("rows").alias("n"), F.sum(F.col("x") * F.col("rows")).alias(value))
    return counted.select(*groups.restored, "bucket", "n", value)


def cumulative_shares(df: DataFrame, by: Sequence[str], value: str, keys: Sequence[str]) -> DataFrame:
    """Running share of the market from the largest row down, as ``cum_share``.

    Rows of equal value follow each other in the order of an MD5 of their keys.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    ranked = attach_ranks(df, by, value, [digest, *[F.col(k) for k in keys]])
    r = F.col("ranks")
    return ranked.withColumn("cum_share", share(r["running_mass"], r["group_mass"])).drop("ranks")


def top_by_market(measures: DataFrame, keys: Sequence[str], markets: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` largest entities of each market with share, dense rank and bucket.

    The market totals come from one wide aggregate over the measures. A row above a top row
    is itself a top row, so dense ranks among the ``k`` kept rows are the ranks in the whole
    market and no full ranking is needed.
    """
    totals = measures.agg(F.struct(*[F.sum(clip_nonneg(m)).alias(m) for m in markets]))
    cells = [
        F.struct(F.lit(m).alias("market"), clip_nonneg(m).alias("capacity"),
                 F.col(f"totals.{m}").alias("total_market"))
        for m in markets
    ]
    rows = measures.withColumn("totals", totals.scalar()).select(*keys, F.inline(F.array(*cells)))
    order = [F.col("capacity").desc_nulls_last(), *[F.col(c) for c in keys]]
    top = top_k_per_group(rows, ["market"], order, k)
    rank = F.dense_rank().over(Window.partitionBy("market").orderBy(F.col("capacity").desc_nulls_last()))
    share_of = share(F.col("capacity"), F.col("total_market"))
    ranked = top.withColumns({"share": share_of, "rank": F.when(F.col("total_market") > 0, rank).otherwise(F.lit(1))})
    return ranked.select(
        "market", *keys, "capacity", "share", F.col("rank").cast("bigint").alias("rank"),
        share_bucket(F.col("rank")).alias("bucket"),
    )


def _compare(shares: DataFrame, keys: Sequence[str], period: str, base: int, current: int, value: str) -> DataFrame:
    def at(p: int) -> Column:
        return F.max(F.when(F.col(period) == p, F.col(value)))

    rows = shares.filter(F.col(period).isin(base, current))
    return rows.groupBy(*keys).agg(at(base).alias(f"{value}_base"), at(current).alias(f"{value}_current"))


def share_evolution(
    shares: DataFrame, base: int, current: int, keys: Sequence[str] = ("actor", "market"), period: str = "period"
) -> DataFrame:
    """Share in two periods, its change, direction (no change is ``Lost``) and size."""
    wide = _compare(shares, keys, period, base, current, "share")
    change = F.col("share_current") - F.col("share_base")
    return wide.withColumn("share_change", change).withColumns({
        "change_direction": F.when(F.col("share_change") > 0, "Gained").when(F.col("share_change") <= 0, "Lost"),
        "change_magnitude": F.abs("share_change"),
    })


def rank_mobility(
    shares: DataFrame,
    base: int,
    current: int,
    keys: Sequence[str] = ("actor", "market"),
    period: str = "period",
    seen_in: DataFrame | None = None,
) -> DataFrame:
    """Rank in two periods and how it moved; a missing period gives no rows.

    A change of exactly -2, or an actor without a rank in one period, is a significant decline.
    """
    wide = _compare(shares, keys, period, base, current, "rank")
    periods = shares if seen_in is None else seen_in
    both_seen = periods.agg(F.bool_or(F.col(period) == base) & F.bool_or(F.col(period) == current)).scalar()
    change = F.col("rank_base") - F.col("rank_current")
    return (
        wide.filter(both_seen)
        .withColumn("rank_change", change)
        .withColumn("mobility", band(F.col("rank_change"), presets.MOBILITY_BANDS, presets.MOBILITY_REST))
    )


def dominance(
    shares: DataFrame,
    markets: Sequence[str],
    threshold: float = presets.DOMINANCE_THRESHOLD,
    period: str = "period",
    market: str = "market",
    seen_in: DataFrame | None = None,
) -> DataFrame:
    """Rows of the last period with a dominance flag and the gap to the best other actor.

    The gap is NULL in a market without a dominant actor. The facts per market are joined by
    broadcast: they have at most ``len(markets)`` rows.
    """
    rows = latest_period(shares, period, seen_in).filter(F.col(market).isin(*markets))
    flag = F.col("share") > threshold
    facts = rows.groupBy(market).agg(
        F.max(F.when(flag, F.col("share"))).alias("best_dominant"),
        F.max(F.when(~flag, F.col("share"))).alias("best_other"),
    )
    gap = facts.select(market, F.try_divide("best_other", "best_dominant").alias("dominant_gap"))
    return rows.withColumn("is_dominant", flag).join(F.broadcast(gap), market, "left")
