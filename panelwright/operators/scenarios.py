"""Scenario projections of one base value per entity.

Scenarios and years are parameters, so each base row is expanded in place: no join, and a
base table that is hash-partitioned by its keys stays so for the aggregations below.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright import presets
from panelwright.presets import Scenario


def _exponential(base: Column, rate: Column, steps: Column) -> Column:
    return F.bround(base * F.pow(1 + rate, steps))


def _logistic(base: Column, ceiling: Column, rate: Column, steps: Column) -> Column:
    return F.bround(ceiling / (1 + F.try_divide(ceiling - base, base) * F.exp(-rate * steps)))


def _slowed_rate(rate: Column, slowdown: Column, step: Column) -> Column:
    return F.when(step == 1, rate).otherwise(F.greatest(F.lit(0.0), rate * F.pow(1 - slowdown, step - 1)))


def _decelerating(base: Column, rate: Column, slowdown: Column, steps: Column) -> Column:
    """Each step grows at a lower rate than the last and is rounded before the next."""
    def grow(level: Column, step: Column) -> Column:
        return F.bround(level * (1 + _slowed_rate(rate, slowdown, step.cast("double"))))

    return F.aggregate(F.sequence(F.lit(1), steps), base, grow)


def _scenario_rows(scenarios: Sequence[Scenario]) -> Column:
    def typed(value, kind: str) -> Column:
        return F.lit(value).cast(kind)

    return F.array(*[
        F.struct(
            typed(s.scenario_id, "int").alias("scenario_id"),
            F.lit(s.name).alias("scenario_name"),
            F.lit(s.kind).alias("kind"),
            typed(s.rate, "double").alias("rate"),
            typed(s.ceiling, "double").alias("ceiling"),
            typed(s.ceiling_multiple, "double").alias("ceiling_multiple"),
            typed(s.slowdown, "double").alias("slowdown"),
            F.lit(s.description).alias("description"),
            F.lit(s.color).alias("color"),
        )
        for s in scenarios
    ])


def project_scenarios(
    base: DataFrame,
    keys: Sequence[str],
    base_col: str,
    scenarios: Sequence[Scenario] = presets.SCENARIOS,
    years: Sequence[int] = presets.PROJECTION_YEARS,
    base_year: int = presets.BASE_YEAR,
) -> DataFrame:
    """One row per entity, scenario and year with the projected capacity.

    Growth compounds from ``base_year``. A logistic path has no effective rate.
    """
    start = F.col("base_value")
    rows = (
        base.select(*keys, F.col(base_col).cast("double").alias("base_value"))
        .select("*", F.inline(_scenario_rows(scenarios)))
        .withColumn("year", F.explode(F.array(*[F.lit(y).cast("int") for y in years])))
        .withColumn("steps", F.col("year") - F.lit(base_year))
    )
    kinds = {s.kind for s in scenarios}
    steps = F.col("steps").cast("double")
    ceiling = F.coalesce(F.col("ceiling"), F.col("ceiling_multiple") * start)
    capacity = F.when(F.col("kind") == "exponential", _exponential(start, F.col("rate"), steps))
    effective = F.when(F.col("kind") == "exponential", F.col("rate"))
    if "logistic" in kinds:
        capacity = capacity.when(F.col("kind") == "logistic", _logistic(start, ceiling, F.col("rate"), steps))
    if "decelerating" in kinds:
        slowed = _decelerating(start, F.col("rate"), F.col("slowdown"), F.col("steps"))
        capacity = capacity.when(F.col("kind") == "decelerating", slowed)
        rate = _slowed_rate(F.col("rate"), F.col("slowdown"), steps)
        effective = effective.when(F.col("kind") == "decelerating", rate)
    scenario_rate = F.when(F.col("kind") != "logistic", F.col("rate"))
    return rows.select(
        *keys, "scenario_id", "scenario_name", "year", "base_value",
        capacity.alias("capacity"),
        effective.alias("effective_rate"),
        scenario_rate.alias("scenario_rate"),
        "description", "color",
    )


def union_projections(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of several projections, columns matched by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def threshold_crossings(
    projection: DataFrame,
    keys: Sequence[str],
    thresholds: Mapping[str, float] = presets.THRESHOLDS,
) -> DataFrame:
    """Per entity and scenario: first year at or over each threshold, growth and final level."""
    last = F.max_by("capacity", "year")
    return projection.groupBy(*keys, "scenario_id", "scenario_name").agg(
        *[F.min(F.when(F.col("capacity") >= edge, F.col("year"))).alias(f"crosses_{name}")
          for name, edge in thresholds.items()],
        ((F.try_divide(last, F.max("base_value")) - 1) * 100).alias("total_growth_pct"),
        (F.avg("effective_rate") * 100).alias("avg_annual_growth"),
        last.alias("final_capacity"),
    )


def compare_to_baseline(
    projection: DataFrame, keys: Sequence[str], baseline: str = presets.BASELINE_SCENARIO
) -> DataFrame:
    """Final-year level of each scenario against the baseline scenario of the same entity.

    The window holds one row per scenario of an entity.
    """
    last = projection.agg(F.max("year")).scalar()
    entity = Window.partitionBy(*keys) if keys else Window.partitionBy(F.col("year"))
    reference = F.max(F.when(F.col("scenario_name") == baseline, F.col("capacity"))).over(entity)
    return projection.filter(F.col("year") == last).select(
        *keys, "scenario_name",
        F.col("capacity").alias("final_capacity"),
        (F.col("capacity") - reference).alias("diff_vs_baseline"),
        ((F.try_divide(F.col("capacity"), reference) - 1) * 100).alias("pct_vs_baseline"),
    )


def rate_sensitivity(
    base: DataFrame,
    keys: Sequence[str],
    base_col: str,
    start: float = presets.RATE_START,
    step: float = presets.RATE_STEP,
    count: int = presets.RATE_COUNT,
    years: Sequence[int] = presets.PROJECTION_YEARS,
    base_year: int = presets.BASE_YEAR,
    thresholds: Mapping[str, float] | None = None,
) -> DataFrame:
    """Highest projected level per entity and growth rate, and whether it meets thresholds.

    The years of one rate are compared inside the row, so nothing is grouped or shuffled.
    """
    if thresholds is None:
        thresholds = {name: presets.THRESHOLDS[name] for name in ("crisis", "high_risk")}
    rates = F.array(*[F.lit(start + i * step) for i in range(count)])
    value = F.col(base_col).cast("double")
    levels = [_exponential(value, F.col("base_rate"), F.lit(float(y - base_year))) for y in years]
    top = F.greatest(*levels) if len(levels) > 1 else levels[0]
    return (
        base.select(*keys, base_col, F.explode(rates).alias("base_rate"))
        .select(*keys, "base_rate", top.alias("final_capacity"))
        .withColumns({f"over_{name}": F.col("final_capacity") >= edge for name, edge in thresholds.items()})
    )
