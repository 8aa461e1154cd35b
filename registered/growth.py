"""Growth decomposition over the customer panel."""

from pyspark.sql import functions as F

from panelwright.operators import concentration, growth, metrics
from registered.base import cte, customer_panel, query, rounded, sql

cte("growth", ("customer_panel",), """
SELECT *, CASE WHEN delta_abs < 0 THEN 0 ELSE delta_abs END AS delta_pos FROM customer_panel
WHERE value_base IS NOT NULL OR value_current IS NOT NULL""")
cte("decomposed", ("growth",), """
SELECT *, delta_frac AS growth_rate,
       delta_pos / nullif((SELECT sum(delta_pos) FROM growth), 0) AS contrib_growth,
       value_current / nullif((SELECT sum(value_current) FROM growth), 0) AS contrib_stock FROM growth""")

GROWTH_CASE = """CASE WHEN growth_rate > CAST(0.25 AS DOUBLE) THEN 'Alto Crecimiento (>25%)'
  WHEN growth_rate > CAST(0.10 AS DOUBLE) THEN 'Crecimiento Moderado (10-25%)'
  WHEN growth_rate > 0 THEN 'Bajo Crecimiento (0-10%)' ELSE 'Decrecimiento/NA' END"""
# Contributions of thousands of customers are tiny: the bands are read on thousandths.
CONTRIB_CASE = """CASE WHEN c > CAST(0.20 AS DOUBLE) THEN 'Motor Principal (>20%)'
  WHEN c > CAST(0.10 AS DOUBLE) THEN 'Contribuyente Alto (10-20%)'
  WHEN c >= CAST(0.05 AS DOUBLE) THEN 'Contribuyente Medio (5-10%)'
  WHEN c > 0 THEN 'Contribuyente Menor (<5%)' ELSE 'Sin crecimiento' END"""


@query("grw01_growth_decomposition", sql("decomposed", """
SELECT category, indicator, value_base, value_current, delta_abs, delta_pos, round(growth_rate, 9) AS growth_rate,
       round(contrib_growth, 12) AS contrib_growth, round(contrib_stock, 12) AS contrib_stock FROM decomposed"""))
def decomposition(spark, sf_dir):
    table = growth.growth_decomposition(customer_panel(spark, sf_dir))
    return table.select(
        "category", "indicator", "value_base", "value_current", "delta_abs", "delta_pos",
        F.round("growth_rate", 9).alias("growth_rate"), F.round("contrib_growth", 12).alias("contrib_growth"),
        F.round("contrib_stock", 12).alias("contrib_stock"),
    )


@query("grw02_growth_category", sql("decomposed", f"""
SELECT category, {GROWTH_CASE} AS growth_category, CAST(count(*) AS BIGINT) AS n, sum(delta_pos) AS delta_pos
FROM decomposed GROUP BY 1, 2"""))
def growth_categories(spark, sf_dir):
    table = growth.growth_decomposition(customer_panel(spark, sf_dir))
    return table.groupBy("category", "growth_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("delta_pos").alias("delta_pos")
    )


@query("grw03_contrib_category", sql("decomposed", f"""
SELECT contrib_category, CAST(count(*) AS BIGINT) AS n, sum(delta_pos) AS delta_pos FROM (
  SELECT delta_pos, {CONTRIB_CASE} AS contrib_category FROM (SELECT delta_pos, contrib_growth * 20 AS c FROM decomposed))
GROUP BY 1"""))
def contribution_categories(spark, sf_dir):
    table = growth.growth_decomposition(customer_panel(spark, sf_dir))
    label = growth.contribution_category(F.col("contrib_growth") * 20)
    return table.groupBy(label.alias("contrib_category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("delta_pos").alias("delta_pos")
    )


@query("grw04_top_contributors", sql("decomposed", """
SELECT category, indicator, value_base, value_current, delta_abs, round(contrib_growth, 12) AS contrib_growth
FROM decomposed WHERE delta_pos > 0"""))
def contributors(spark, sf_dir):
    table = growth.top_contributors(growth.growth_decomposition(customer_panel(spark, sf_dir)))
    return table.select("category", "indicator", "value_base", "value_current", "delta_abs",
                        F.round("contrib_growth", 12).alias("contrib_growth"))


cte("growth_sorted", ("growth",), """
SELECT delta_pos AS x, row_number() OVER (ORDER BY delta_pos) AS i, row_number() OVER (ORDER BY delta_pos DESC) AS d,
       count(*) OVER () AS n, sum(delta_pos) OVER () AS s FROM growth WHERE delta_pos IS NOT NULL""")

PARETO = """(SELECT sum(x) FROM growth_sorted WHERE d <= greatest(1, ceil((SELECT count(*) FROM growth) * CAST({p} AS DOUBLE))))
  / nullif((SELECT sum(delta_pos) FROM growth), 0)"""


@query("grw05_growth_metrics", sql("growth_sorted", f"""
SELECT 'gini_growth_pos' AS metric, round(2 * sum(i * x) / (max(n) * max(s)) - (max(n) + 1) / CAST(max(n) AS DOUBLE), 9) AS value
FROM growth_sorted
UNION ALL SELECT 'pareto_top20_pos', round({PARETO.format(p=0.2)}, 9)
UNION ALL SELECT 'pareto_top50_pos', round({PARETO.format(p=0.5)}, 9)
UNION ALL SELECT 'total_growth_pos', sum(delta_pos) FROM growth
UNION ALL SELECT 'total_growth_net', sum(delta_abs) FROM growth
UNION ALL SELECT 'n_indicators', CAST(count(*) AS DOUBLE) FROM growth"""))
def growth_metrics(spark, sf_dir):
    return rounded(metrics.metrics_long(growth.growth_metrics(customer_panel(spark, sf_dir))))


@query("grw06_pareto_share", sql("growth_sorted", f"""
SELECT round({PARETO.format(p=0.01)}, 9) AS top1, round({PARETO.format(p=0.1)}, 9) AS top10,
       round({PARETO.format(p=0.2)}, 9) AS top20, round({PARETO.format(p=0.5)}, 9) AS top50"""))
def pareto(spark, sf_dir):
    rows = growth.positive_growth(customer_panel(spark, sf_dir))
    return rounded(concentration.top_share(rows, "delta_pos", [0.01, 0.1, 0.2, 0.5]))
