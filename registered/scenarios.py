"""Projections of each customer's current level."""

from pyspark.sql import functions as F

from panelwright.operators import scenarios
from panelwright.presets import Scenario
from registered.base import CURRENT, cte, customer_panel, query, rounded, sql

KEYS = ["category", "indicator"]
YEARS = list(range(CURRENT + 1, CURRENT + 6))
LAST = YEARS[-1]
THRESHOLDS = {"crisis": 6e7, "high_risk": 4e7, "medium_risk": 2e7}
SCENARIOS = (
    Scenario(1, "Continuidad", 0.235),
    Scenario(2, "Contención Parcial", 0.10),
    Scenario(3, "Estabilización", 0.0),
    Scenario(4, "Reversión", -0.05),
    Scenario(5, "Saturación", 0.35, kind="logistic", ceiling_multiple=1.3),
)
SLOWING = (Scenario(6, "Desaceleración", 0.235, kind="decelerating"),)


def base(spark, sf_dir):
    return customer_panel(spark, sf_dir).filter(F.col("value_current").isNotNull()).select(*KEYS, "value_current")


def projection(spark, sf_dir, chosen=SCENARIOS):
    return scenarios.project_scenarios(base(spark, sf_dir), KEYS, "value_current", chosen, YEARS, CURRENT)


cte("scenario", (), """
SELECT * FROM (VALUES (1, 'Continuidad', CAST(0.235 AS DOUBLE), 'exponential'),
  (2, 'Contención Parcial', CAST(0.10 AS DOUBLE), 'exponential'), (3, 'Estabilización', CAST(0.0 AS DOUBLE), 'exponential'),
  (4, 'Reversión', CAST(-0.05 AS DOUBLE), 'exponential'), (5, 'Saturación', CAST(0.35 AS DOUBLE), 'logistic'))
  AS s(scenario_id, scenario_name, rate, kind)""")
cte("projected", ("customer_panel", "scenario"), f"""
SELECT category, indicator, scenario_id, scenario_name, CAST(year AS INTEGER) AS year, n0 AS base_value,
       CASE kind WHEN 'exponential' THEN round_even(n0 * pow(1 + rate, CAST(year - {CURRENT} AS DOUBLE)), 0)
         ELSE round_even(CAST(1.3 AS DOUBLE) * n0 / (1 + ((CAST(1.3 AS DOUBLE) * n0 - n0) / n0)
                         * exp(-rate * CAST(year - {CURRENT} AS DOUBLE))), 0) END AS capacity,
       CASE kind WHEN 'exponential' THEN rate END AS effective_rate,
       CASE kind WHEN 'exponential' THEN rate END AS scenario_rate
FROM (SELECT category, indicator, value_current AS n0 FROM customer_panel WHERE value_current IS NOT NULL)
CROSS JOIN scenario CROSS JOIN (SELECT unnest(range({YEARS[0]}, {LAST + 1})) AS year)""")


def projected(kind):
    test = {"exponential": "scenario_id <= 4", "logistic": "scenario_id = 5"}[kind]
    return sql("projected", f"""
SELECT category, indicator, scenario_id, scenario_name, year, base_value, CAST(capacity AS DOUBLE) AS capacity,
       effective_rate, scenario_rate FROM projected WHERE {test}""")


@query("scn01_project_exponential", projected("exponential"))
def exponential(spark, sf_dir):
    return projection(spark, sf_dir, SCENARIOS[:4]).drop("description", "color")


@query("scn02_project_logistic", projected("logistic"))
def logistic(spark, sf_dir):
    return projection(spark, sf_dir, SCENARIOS[4:]).drop("description", "color")


cte("slowing", ("customer_panel",), f"""
SELECT category, indicator, {CURRENT} AS year, value_current AS capacity, CAST(NULL AS DOUBLE) AS rate
FROM customer_panel WHERE value_current IS NOT NULL
UNION ALL
SELECT category, indicator, year + 1,
       round_even(capacity * (1 + greatest(0, CAST(0.235 AS DOUBLE) * pow(CAST(0.85 AS DOUBLE), CAST(year - {CURRENT} AS DOUBLE)))), 0),
       greatest(0, CAST(0.235 AS DOUBLE) * pow(CAST(0.85 AS DOUBLE), CAST(year - {CURRENT} AS DOUBLE)))
FROM slowing WHERE year < {LAST}""")


@query("scn03_project_decelerating", sql("slowing", f"""
SELECT category, indicator, CAST(year AS INTEGER) AS year, CAST(capacity AS DOUBLE) AS capacity,
       round(rate, 12) AS effective_rate FROM slowing WHERE year > {CURRENT}""").replace("WITH ", "WITH RECURSIVE ", 1))
def decelerating(spark, sf_dir):
    rows = projection(spark, sf_dir, SLOWING).select(*KEYS, "year", "capacity", "effective_rate")
    return rounded(rows, 12)


@query("scn04_union_projections", sql("projected", """
SELECT scenario_id, scenario_name, year, CAST(count(*) AS BIGINT) AS n, CAST(sum(capacity) AS DOUBLE) AS capacity
FROM projected GROUP BY 1, 2, 3"""))
def union(spark, sf_dir):
    rows = base(spark, sf_dir)
    parts = [
        scenarios.project_scenarios(rows, KEYS, "value_current", chosen, YEARS, CURRENT)
        for chosen in (SCENARIOS[:4], SCENARIOS[4:])
    ]
    return scenarios.union_projections(parts).groupBy("scenario_id", "scenario_name", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("capacity").alias("capacity")
    )


@query("scn05_threshold_crossings", sql("projected", """
SELECT category, indicator, scenario_id, scenario_name,
       min(CASE WHEN capacity >= 60000000 THEN year END) AS crosses_crisis,
       min(CASE WHEN capacity >= 40000000 THEN year END) AS crosses_high_risk,
       min(CASE WHEN capacity >= 20000000 THEN year END) AS crosses_medium_risk,
       round((max_by(capacity, year) / max(base_value) - 1) * 100, 6) AS total_growth_pct,
       round(avg(effective_rate) * 100, 6) AS avg_annual_growth,
       CAST(max_by(capacity, year) AS DOUBLE) AS final_capacity
FROM projected GROUP BY 1, 2, 3, 4"""))
def crossings(spark, sf_dir):
    return rounded(scenarios.threshold_crossings(projection(spark, sf_dir), KEYS, THRESHOLDS), 6)


@query("scn06_compare_to_baseline", sql("projected", f"""
WITH f AS (SELECT category, indicator, scenario_name, capacity,
       max(CASE WHEN scenario_name = 'Continuidad' THEN capacity END) OVER (PARTITION BY category, indicator) AS reference
     FROM projected WHERE year = {LAST})
SELECT category, indicator, scenario_name, CAST(capacity AS DOUBLE) AS final_capacity,
       CAST(capacity - reference AS DOUBLE) AS diff_vs_baseline,
       round((capacity / nullif(reference, 0) - 1) * 100, 6) AS pct_vs_baseline FROM f"""))
def baseline(spark, sf_dir):
    return rounded(scenarios.compare_to_baseline(projection(spark, sf_dir), KEYS), 6)


@query("scn07_rate_sensitivity", sql("customer_panel", f"""
WITH r AS (SELECT category, indicator, CAST(0.15 AS DOUBLE) + i * CAST(0.01 AS DOUBLE) AS base_rate, value_current AS n0, year
  FROM customer_panel CROSS JOIN (SELECT unnest(range(0, 16)) AS i)
  CROSS JOIN (SELECT unnest(range({YEARS[0]}, {LAST + 1})) AS year) WHERE value_current IS NOT NULL),
 m AS (SELECT category, indicator, base_rate,
       max(CAST(round_even(n0 * pow(1 + base_rate, CAST(year - {CURRENT} AS DOUBLE)), 0) AS DOUBLE)) AS final_capacity
  FROM r GROUP BY 1, 2, 3)
SELECT category, indicator, round(base_rate, 9) AS base_rate, final_capacity,
       final_capacity >= 60000000 AS over_crisis, final_capacity >= 40000000 AS over_high_risk FROM m"""))
def sensitivity(spark, sf_dir):
    limits = {name: THRESHOLDS[name] for name in ("crisis", "high_risk")}
    return rounded(scenarios.rate_sensitivity(
        base(spark, sf_dir), KEYS, "value_current", years=YEARS, base_year=CURRENT, thresholds=limits
    ))
