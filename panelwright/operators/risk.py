"""Banded, weighted risk score per entity.

The codes are a short parameter list, so an entity's indicators are aggregated straight into
one wide row, a pair of sums per code, by one shuffle on the entity with partial sums before
it. Missing codes come out as zero without a join against the list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import presets
from panelwright.functions import band, finite_or_null, safe_pct
from panelwright.presets import RiskIndicator

BROADCAST_VECTORS = 1 << 16  # combinations of points whose results are sent to every task


def map_codes(df: DataFrame, indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS,
              column: str = "indicator") -> DataFrame:
    """Code of the first indicator all of whose patterns the lower-cased name matches."""
    name = F.lower(F.col(column))
    code = None
    for i in indicators:
        test = F.lit(True)
        for pattern in i.patterns:
            test = test & name.rlike(pattern)
        code = F.when(test, F.lit(i.code)) if code is None else code.when(test, F.lit(i.code))
    return df.withColumn("code", code)


def keep_known_codes(df: DataFrame, indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS) -> DataFrame:
    return df.filter(F.col("code").isin(*[i.code for i in indicators]))


def _repaired(delta: Column, base: Column, current: Column) -> Column:
    known = delta.isNotNull() & (delta != 0)
    return F.when(known, delta).when(base.isNotNull() & current.isNotNull(), current - base).otherwise(delta)


def collapse_codes(coded: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Sum levels and changes per entity and code; repair the change; percent change.

    The labels are those of the first row in (category, indicator) order.
    """
    def total(c: str) -> Column:
        return F.coalesce(F.sum(finite_or_null(c)), F.lit(0.0))

    first = F.min(F.struct("category", "indicator"))
    sums = coded.groupBy(*entity, "code").agg(
        first.alias("label"),
        total("value_base").alias("value_base"),
        total("value_current").alias("value_current"),
        total("delta_abs").alias("delta_sum"),
    )
    base, current = F.col("value_base"), F.col("value_current")
    return sums.select(
        *entity, "code",
        F.col("label.indicator").alias("indicator"), F.col("label.category").alias("category"),
        "value_base", "value_current",
        _repaired(F.col("delta_sum"), base, current).alias("delta_abs"),
        safe_pct(base, current).alias("pct_change"),
    )


def adjust_direction(pct: Column, direction: Column) -> Column:
    return F.when(direction == "-", -pct).otherwise(pct)


def band_score(adjusted: Column) -> Column:
    return band(adjusted, presets.SCORE_BANDS, 0)


def score_components(
    coded: DataFrame,
    entity: Sequence[str],
    indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS,
    labels: bool = False,
) -> DataFrame:
    """Every indicator of every entity with its change, points and weighted score.

    Entities are those of ``coded``; an indicator that an entity lacks has NULL levels and
    scores zero. Without ``labels`` the aggregation holds numbers only and stays a hash
    aggregation.
    """
    aggregates = []
    for i in indicators:
        here = F.col("code") == i.code
        for c in ("value_base", "value_current"):
            aggregates.append(F.sum(F.when(here, F.coalesce(finite_or_null(c), F.lit(0.0)))).alias(f"{i.code}_{c}"))
        if labels:
            aggregates.append(F.min(F.when(here, F.struct("category", "indicator"))).alias(f"{i.code}_label"))
    wide = coded.groupBy(*entity).agg(*aggregates) if entity else coded.agg(*aggregates)
    cells = []
    for i in indicators:
        fields = [
            F.lit(i.code).alias("code"),
            F.lit(i.name).alias("name"),
            F.col(f"{i.code}_value_base").alias("value_base"),
            F.col(f"{i.code}_value_current").alias("value_current"),
            F.lit(i.weight).alias("weight"),
            F.lit(i.direction).alias("direction"),
        ]
        if labels:
            fields += [F.col(f"{i.code}_label.{c}").alias(c) for c in ("category", "indicator")]
        cells.append(F.struct(*fields))
    rows = wide.select(*entity, F.inline(F.array(*cells)))
    shown = ["category", "indicator"] if labels else []
    return (
        rows.withColumn("pct_change", safe_pct(F.col("value_base"), F.col("value_current")))
        .withColumn("adjusted_change", adjust_direction(F.col("pct_change"), F.col("direction")))
        .withColumn("raw_score", band_score(F.col("adjusted_change")))
        .withColumn("weighted_score", F.col("raw_score") * F.col("weight"))
        .select(*entity, "code", "name", *shown, "value_base", "value_current", "pct_change",
                "adjusted_change", "raw_score", "weight", "weighted_score")
    )


def max_possible(indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS) -> float:
    return sum(i.weight * presets.MAX_POINTS for i in indicators)


def classify(
    total: Column,
    classes: Sequence[str] = presets.RISK_CLASSES,
    red: float = presets.RED_THRESHOLD,
    amber: float = presets.AMBER_THRESHOLD,
) -> Column:
    return F.when(total >= red, classes[0]).when(total >= amber, classes[1]).otherwise(classes[2])


def total_scores(
    components: DataFrame,
    entity: Sequence[str],
    indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS,
    red: float = presets.RED_THRESHOLD,
    amber: float = presets.AMBER_THRESHOLD,
) -> DataFrame:
    """Total score, class and highest possible score per entity."""
    total = F.sum("weighted_score").alias("total_score")
    totals = components.groupBy(*entity).agg(total) if entity else components.agg(total)
    return totals.withColumns({
        "risk_class": classify(F.col("total_score"), red=red, amber=amber),
        "max_possible": F.lit(float(max_possible(indicators))),
    })


def score_contribution(components: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Each indicator's share of its entity's score, in percent; zero when the score is zero.

    The window holds one row per indicator code.
    """
    total = F.sum("weighted_score").over(Window.partitionBy(*entity))
    part = F.when(total > 0, F.col("weighted_score") / total * 100).otherwise(F.lit(0.0))
    return components.withColumn("contribution_pct", part)


def raw_scores(components: DataFrame, entity: Sequence[str],
               indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS) -> DataFrame:
    """Points per code as columns ``raw_<code>``, one row per entity."""
    points = [F.max(F.when(F.col("code") == i.code, F.col("raw_score"))).alias(f"raw_{i.code}") for i in indicators]
    return components.groupBy(*entity).agg(*points) if entity else components.agg(*points)


def weight_sensitivity(
    raw: DataFrame,
    entity: Sequence[str],
    indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS,
    grid: Mapping[str, tuple[float, float, int]] = presets.WEIGHT_GRID,
    red: float = presets.RED_THRESHOLD,
    amber: float = presets.AMBER_THRESHOLD,
) -> DataFrame:
    """Score and class of each entity under each combination of the varied weights.

    The combinations are exploded in place: no join, and the rows of an entity stay
    together for ``sensitivity_stats``. Combinations are numbered with the last code
    varying fastest.
    """
    rows = raw
    number = F.lit(0)
    for code, (start, step, count) in grid.items():
        weights = F.array(*[F.lit(start + i * step) for i in range(count)])
        rows = rows.select("*", F.posexplode(weights).alias(f"at_{code}", f"weight_{code}"))
        number = number * count + F.col(f"at_{code}")
    total = F.lit(0.0)
    for i in indicators:
        weight = F.col(f"weight_{i.code}") if i.code in grid else F.lit(i.weight)
        total = total + F.coalesce(F.col(f"raw_{i.code}"), F.lit(0)) * weight
    return rows.select(
        *entity, (number + 1).alias("scenario_id"), *[f"weight_{c}" for c in grid], total.alias("total_score")
    ).withColumn("class_varied", classify(F.col("total_score"), presets.SHORT_CLASSES, red, amber))


def sensitivity_stats(sensitivity: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Range, mean and spread of the scores and the share of each class, per entity."""
    def pct(name: str) -> Column:
        return F.avg((F.col("class_varied") == name).cast("double")) * 100

    red, amber, green = presets.SHORT_CLASSES
    score = F.col("total_score")
    stats = [
        F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("sd_score"),
        pct(red).alias("pct_red"), pct(amber).alias("pct_amber"), pct(green).alias("pct_green"),
    ]
    return sensitivity.groupBy(*entity).agg(*stats) if entity else sensitivity.agg(*stats)


def weight_sensitivity_stats(
    raw: DataFrame,
    entity: Sequence[str],
    indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS,
    grid: Mapping[str, tuple[float, float, int]] = presets.WEIGHT_GRID,
    red: float = presets.RED_THRESHOLD,
    amber: float = presets.AMBER_THRESHOLD,
) -> DataFrame:
    """``sensitivity_stats`` of ``weight_sensitivity``, one row per row of ``raw``, without its grid per entity.

    Entities with the same points share all their results. There are only as many combinations of points
    as (points + 1) to the power of the codes, so the grid is worked out per combination that occurs.
    Up to ``BROADCAST_VECTORS`` possible ones go to every task, and entities are not moved; with more
    codes Spark chooses the join by size.
    """
    names = [f"raw_{i.code}" for i in indicators]
    points = [F.coalesce(F.col(n), F.lit(0)).cast("int").alias(f"points_{n}") for n in names]
    keys = [f"points_{n}" for n in names]
    rows = raw.select(*entity, *points)
    vectors = rows.select(*keys).distinct().select(*keys, *[F.col(f"points_{n}").alias(n) for n in names])
    stats = sensitivity_stats(weight_sensitivity(vectors, keys, indicators, grid, red, amber), keys)
    if (presets.MAX_POINTS + 1) ** len(names) <= BROADCAST_VECTORS:
        stats = F.broadcast(stats)
    return rows.join(stats, keys).drop(*keys)


def implications(
    components: DataFrame,
    entity: Sequence[str],
    indicators: Sequence[RiskIndicator] = presets.RISK_INDICATORS,
    texts: Mapping[str, tuple[list[str], list[str]]] = presets.IMPLICATIONS,
    critical: float = presets.CRITICAL_SCORE,
    red: float = presets.RED_THRESHOLD,
    amber: float = presets.AMBER_THRESHOLD,
) -> DataFrame:
    """Class of each entity with the actions it calls for and, when red, its critical indicators.

    Critical indicators are listed by score, highest first, then by points and position in
    ``indicators``. One aggregation gives score and list: an entity has one row per code.
    """
    position = F.lit(len(indicators))
    for at, i in enumerate(indicators):
        position = F.when(F.col("code") == i.code, F.lit(at)).otherwise(position)
    entry = F.struct((-F.col("weighted_score")).alias("score"), (-F.col("raw_score")).alias("points"),
                     position.alias("position"), F.col("name").alias("name"))
    listed = F.sort_array(F.collect_list(F.when(F.col("weighted_score") >= critical, entry)))
    aggregates = [F.sum("weighted_score").alias("total_score"), listed.alias("listed")]
    per_entity = components.groupBy(*entity).agg(*aggregates) if entity else components.agg(*aggregates)
    scored = per_entity.withColumn("risk_class", classify(F.col("total_score"), red=red, amber=amber))

    def text(which: int) -> Column:
        out = F.lit(None).cast("string")
        for name, lists in texts.items():
            out = F.when(F.col("risk_class") == name, F.lit("; ".join(lists[which]))).otherwise(out)
        return out

    is_red = F.col("risk_class") == presets.RISK_CLASSES[0]
    names = F.array_join(F.col("listed.name"), "; ")
    return scored.select(
        *entity, "risk_class",
        text(0).alias("immediate_actions"), text(1).alias("recommended_changes"),
        F.when(is_red, names).alias("critical_indicators"),
    )


def risk_summary(totals: DataFrame, source: str, entity: Sequence[str] = ()) -> DataFrame:
    """Totals as a long table of texts: entity, metric, value."""
    metrics = F.array(
        F.struct(F.lit("total_score").alias("metric"), F.bround("total_score", 3).cast("string").alias("value")),
        F.struct(F.lit("risk_classification").alias("metric"), F.col("risk_class").alias("value")),
        F.struct(F.lit("max_possible").alias("metric"), F.bround("max_possible", 3).cast("string").alias("value")),
        F.struct(F.lit("input_panel").alias("metric"), F.lit(source).alias("value")),
    )
    return totals.select(*entity, F.inline(metrics))
