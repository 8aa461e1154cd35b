"""Risk score of each user from the change of its event counts."""

from pyspark.sql import functions as F

from panelwright.operators import risk
from panelwright.presets import RiskIndicator
from registered.base import cte, query, rounded, sql, user_panel

ENTITY = ["entity"]
# error rows need both patterns; "view" is left out, so it has no code.
INDICATORS = (
    RiskIndicator("ERR", "Errors in the low band", 1.0, "+", ("error", "low")),
    RiskIndicator("PUR", "Purchases", 1.5, "+", ("purchase",)),
    RiskIndicator("SGN", "Signups", 1.2, "+", ("signup",)),
    RiskIndicator("CLK", "Clicks", 0.8, "-", ("click",)),
)
GRID = {"ERR": (0.8, 0.1, 5), "PUR": (1.3, 0.1, 5), "SGN": (1.0, 0.1, 5)}

cte("risk_dimension", (), """
SELECT * FROM (VALUES ('ERR', 'Errors in the low band', CAST(1.0 AS DOUBLE), '+', 0), ('PUR', 'Purchases', CAST(1.5 AS DOUBLE), '+', 1),
  ('SGN', 'Signups', CAST(1.2 AS DOUBLE), '+', 2), ('CLK', 'Clicks', CAST(0.8 AS DOUBLE), '-', 3)) AS d(code, name, weight, direction, pos)""")
cte("coded", ("user_panel",), """
SELECT *, CASE WHEN regexp_matches(lower(indicator), 'error') AND regexp_matches(lower(indicator), 'low') THEN 'ERR'
         WHEN regexp_matches(lower(indicator), 'purchase') THEN 'PUR'
         WHEN regexp_matches(lower(indicator), 'signup') THEN 'SGN'
         WHEN regexp_matches(lower(indicator), 'click') THEN 'CLK' END AS code FROM user_panel""")
cte("collapsed", ("coded",), """
SELECT entity, code, first(indicator ORDER BY category, indicator) AS indicator,
       first(category ORDER BY category, indicator) AS category,
       coalesce(sum(value_base), 0) AS value_base, coalesce(sum(value_current), 0) AS value_current,
       coalesce(sum(delta_abs), 0) AS delta_sum
FROM coded WHERE code IS NOT NULL GROUP BY 1, 2""")
cte("components", ("collapsed", "risk_dimension"), """
SELECT *, raw_score * weight AS weighted_score FROM (
SELECT *, CASE WHEN adjusted_change IS NULL THEN 0 WHEN adjusted_change >= 100 THEN 3 WHEN adjusted_change >= 50 THEN 2
         WHEN adjusted_change >= 20 THEN 1 ELSE 0 END AS raw_score FROM (
SELECT *, CASE WHEN direction = '-' THEN -pct_change ELSE pct_change END AS adjusted_change FROM (
SELECT e.entity, d.code, d.name, d.weight, d.direction, d.pos, c.category, c.indicator, c.value_base, c.value_current,
       CASE WHEN c.value_base > 0 THEN (c.value_current - c.value_base) / c.value_base * 100 END AS pct_change
FROM (SELECT DISTINCT entity FROM coded WHERE code IS NOT NULL) e CROSS JOIN risk_dimension d
LEFT JOIN collapsed c ON c.entity = e.entity AND c.code = d.code)))""")
CLASS = """CASE WHEN total_score >= 7 THEN '{0}' WHEN total_score >= 4 THEN '{1}' ELSE '{2}' END"""
RISK_CLASS = CLASS.format("ALTO (ROJO)", "MEDIO (ÁMBAR)", "BAJO (VERDE)")
SHORT_CLASS = CLASS.format("ROJO", "ÁMBAR", "VERDE")
# The sum of the weighted scores is rounded in both engines before it meets a threshold.
cte("totals", ("components",), """
SELECT entity, round(sum(weighted_score), 9) AS total_score FROM components GROUP BY 1""")


def coded(spark, sf_dir):
    return risk.keep_known_codes(risk.map_codes(user_panel(spark, sf_dir), INDICATORS), INDICATORS)


def components(spark, sf_dir, labels=False):
    return risk.score_components(coded(spark, sf_dir), ENTITY, INDICATORS, labels)


def totals(spark, sf_dir):
    return risk.total_scores(components(spark, sf_dir), ENTITY, INDICATORS)


@query("rsk01_map_codes", sql("coded", "SELECT entity, indicator, code FROM coded"))
def codes(spark, sf_dir):
    return risk.map_codes(user_panel(spark, sf_dir), INDICATORS).select("entity", "indicator", "code")


@query("rsk02_keep_known_codes", sql("coded", """
SELECT entity, indicator, code, value_base, value_current FROM coded WHERE code IS NOT NULL"""))
def known(spark, sf_dir):
    return coded(spark, sf_dir).select("entity", "indicator", "code", "value_base", "value_current")


@query("rsk03_collapse_codes", sql("collapsed", """
SELECT entity, code, indicator, category, value_base, value_current FROM collapsed"""))
def collapsed(spark, sf_dir):
    return risk.collapse_codes(coded(spark, sf_dir), ENTITY).drop("delta_abs", "pct_change")


@query("rsk04_repair_delta", sql("collapsed", """
SELECT entity, code, CASE WHEN delta_sum = 0 THEN value_current - value_base ELSE delta_sum END AS delta_abs FROM collapsed"""))
def repaired(spark, sf_dir):
    return risk.collapse_codes(coded(spark, sf_dir), ENTITY).select("entity", "code", "delta_abs")


@query("rsk05_safe_pct", sql("collapsed", """
SELECT entity, code, round(CASE WHEN value_base > 0 THEN (value_current - value_base) / value_base * 100 END, 9) AS pct_change
FROM collapsed"""))
def pct(spark, sf_dir):
    return rounded(risk.collapse_codes(coded(spark, sf_dir), ENTITY).select("entity", "code", "pct_change"))


@query("rsk06_all_codes", sql("components", """
SELECT entity, code, name, category, indicator, value_base, value_current, weight FROM components"""))
def all_codes(spark, sf_dir):
    table = components(spark, sf_dir, labels=True)
    return table.select("entity", "code", "name", "category", "indicator", "value_base", "value_current", "weight")


@query("rsk07_adjust_direction", sql("components", """
SELECT entity, code, round(adjusted_change, 9) AS adjusted_change FROM components"""))
def adjusted(spark, sf_dir):
    return rounded(components(spark, sf_dir).select("entity", "code", "adjusted_change"))


@query("rsk08_band_score", sql("components", """
SELECT code, CAST(raw_score AS INTEGER) AS raw_score, CAST(count(*) AS BIGINT) AS n FROM components GROUP BY 1, 2"""))
def banded(spark, sf_dir):
    return components(spark, sf_dir).groupBy("code", "raw_score").agg(F.count(F.lit(1)).alias("n"))


@query("rsk09_total_score", sql("totals", """
SELECT entity, total_score, CAST(13.5 AS DOUBLE) AS max_possible FROM totals"""))
def total_score(spark, sf_dir):
    return rounded(totals(spark, sf_dir).select("entity", "total_score", "max_possible"))


@query("rsk10_classify", sql("totals", f"SELECT entity, {RISK_CLASS} AS risk_class FROM totals"))
def classes(spark, sf_dir):
    return totals(spark, sf_dir).select("entity", "risk_class")


@query("rsk11_score_components", sql("components", """
SELECT entity, code, name, value_base, value_current, round(pct_change, 9) AS pct_change,
       CAST(raw_score AS INTEGER) AS raw_score, weight, round(weighted_score, 9) AS weighted_score FROM components"""))
def component_table(spark, sf_dir):
    return rounded(components(spark, sf_dir).drop("adjusted_change"))


@query("rsk12_score_contribution", sql("components", """
SELECT entity, code, round(CASE WHEN sum(weighted_score) OVER w > 0
         THEN weighted_score / sum(weighted_score) OVER w * 100 ELSE 0 END, 9) AS contribution_pct
FROM components WINDOW w AS (PARTITION BY entity)"""))
def contribution(spark, sf_dir):
    table = risk.score_contribution(components(spark, sf_dir), ENTITY)
    return rounded(table.select("entity", "code", "contribution_pct"))


cte("raw_points", ("components",), """
SELECT entity, """ + ", ".join(f"max(CASE WHEN code = '{i.code}' THEN raw_score END) AS {i.code.lower()}"
                               for i in INDICATORS) + " FROM components GROUP BY 1")
cte("varied", ("raw_points",), """
SELECT entity, CAST(i * 25 + j * 5 + k + 1 AS INTEGER) AS scenario_id,
       CAST(0.8 AS DOUBLE) + i * CAST(0.1 AS DOUBLE) AS w_err, CAST(1.3 AS DOUBLE) + j * CAST(0.1 AS DOUBLE) AS w_pur,
       CAST(1.0 AS DOUBLE) + k * CAST(0.1 AS DOUBLE) AS w_sgn,
       err * (CAST(0.8 AS DOUBLE) + i * CAST(0.1 AS DOUBLE)) + pur * (CAST(1.3 AS DOUBLE) + j * CAST(0.1 AS DOUBLE))
       + sgn * (CAST(1.0 AS DOUBLE) + k * CAST(0.1 AS DOUBLE)) + clk * CAST(0.8 AS DOUBLE) AS total_score
FROM raw_points CROSS JOIN (SELECT unnest(range(0, 5)) AS i) CROSS JOIN (SELECT unnest(range(0, 5)) AS j)
CROSS JOIN (SELECT unnest(range(0, 5)) AS k)""")


def varied(spark, sf_dir):
    raw = risk.raw_scores(components(spark, sf_dir), ENTITY, INDICATORS)
    return risk.weight_sensitivity(raw, ENTITY, INDICATORS, GRID)


@query("rsk13_weight_sensitivity", sql("varied", f"""
SELECT entity, scenario_id, round(w_err, 9) AS "weight_ERR", round(w_pur, 9) AS "weight_PUR", round(w_sgn, 9) AS "weight_SGN",
       round(total_score, 9) AS total_score, {SHORT_CLASS} AS class_varied FROM varied"""))
def sensitivity(spark, sf_dir):
    return rounded(varied(spark, sf_dir))


@query("rsk14_sensitivity_stats", sql("varied", """
SELECT entity, round(min(total_score), 9) AS min_score, round(max(total_score), 9) AS max_score,
       round(avg(total_score), 9) AS mean_score, round(stddev_samp(total_score), 9) AS sd_score,
       round(avg(CASE WHEN total_score >= 7 THEN 100.0 ELSE 0.0 END), 9) AS pct_red,
       round(avg(CASE WHEN total_score >= 4 AND total_score < 7 THEN 100.0 ELSE 0.0 END), 9) AS pct_amber,
       round(avg(CASE WHEN total_score < 4 THEN 100.0 ELSE 0.0 END), 9) AS pct_green
FROM varied GROUP BY 1"""))
def stats(spark, sf_dir):
    raw = risk.raw_scores(components(spark, sf_dir), ENTITY, INDICATORS)
    return rounded(risk.weight_sensitivity_stats(raw, ENTITY, INDICATORS, GRID))


ACTIONS = """CASE WHEN total_score >= 7 THEN 'Activar protocolo de crisis estratégica; Revisión urgente de doctrina operativa; Aumento de inteligencia y vigilancia; Coordinación interagencial prioritaria'
  WHEN total_score >= 4 THEN 'Reforzar monitoreo de indicadores; Ajustes operativos preventivos; Coordinación interinstitucional'
  ELSE 'Mantener monitoreo rutinario; Continuar estrategias actuales; Fortalecer capacidades preventivas' END"""
CHANGES = """CASE WHEN total_score >= 7 THEN 'Reasignación de recursos a zonas críticas; Refuerzo de capacidades de respuesta rápida; Diplomacia de crisis con actores regionales'
  WHEN total_score >= 4 THEN 'Mejora de capacidades de inteligencia; Fortalecimiento de respuesta temprana; Diálogo preventivo con comunidades'
  ELSE 'Inversión en capacidades a largo plazo; Mejora de sistemas de alerta temprana; Diplomacia preventiva' END"""


@query("rsk15_implications", sql(("totals", "components"), f"""
SELECT t.entity, {RISK_CLASS} AS risk_class, {ACTIONS} AS immediate_actions, {CHANGES} AS recommended_changes,
       CASE WHEN total_score >= 7 THEN (SELECT coalesce(string_agg(name, '; ' ORDER BY weighted_score DESC, raw_score DESC, pos), '')
         FROM components c WHERE c.entity = t.entity AND weighted_score >= 2) END AS critical_indicators
FROM totals t"""))
def implied(spark, sf_dir):
    return risk.implications(components(spark, sf_dir), ENTITY, INDICATORS)


@query("rsk16_risk_summary", sql("totals", f"""
SELECT entity, 'total_score' AS metric, CAST(CAST(round_even(total_score, 3) AS DOUBLE) AS VARCHAR) AS value FROM totals
UNION ALL SELECT entity, 'risk_classification', {RISK_CLASS} FROM totals
UNION ALL SELECT entity, 'max_possible', '13.5' FROM totals
UNION ALL SELECT entity, 'input_panel', 'user_panel' FROM totals"""))
def summary(spark, sf_dir):
    return risk.risk_summary(totals(spark, sf_dir), "user_panel", ENTITY)
