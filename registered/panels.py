"""Panels, profiles and contracts."""

from pyspark.sql import functions as F

from panelwright.operators import metrics, panel as panels, quality
from registered.base import (
    BASE, CURRENT, PERIODS, customer_long, customer_panel, nation_long, query, rounded, sql, table,
)

KEYS = ["category", "indicator", "unit"]


@query("pnl01_long_panel", sql("messy_long", "SELECT * FROM messy_long"))
def long_panel(spark, sf_dir):
    from panelwright.functions import blank_to_null
    from registered.ingest import messy_long

    return panels.long_panel(messy_long(spark, sf_dir).withColumn("unit", blank_to_null("unit")))


@query("pnl02_pivot_compare", sql("customer_long", f"""
SELECT category, indicator, unit, max(CASE WHEN period = {BASE} THEN value END) AS value_base,
       max(CASE WHEN period = {CURRENT} THEN value END) AS value_current
FROM customer_long WHERE period IN ({BASE}, {CURRENT}) GROUP BY 1, 2, 3"""))
def pivoted(spark, sf_dir):
    return panels.pivot_compare(customer_long(spark, sf_dir, [BASE, CURRENT]), BASE, CURRENT, KEYS)


@query("pnl02_pivot_combine", sql("customer_wide", "SELECT * FROM customer_wide"))
def pivoted_sum(spark, sf_dir):
    return customer_panel(spark, sf_dir).drop("delta_abs", "delta_frac")


@query("pnl03_add_deltas", sql("customer_panel", """
SELECT category, indicator, unit, value_base, value_current, delta_abs, round(delta_frac, 9) AS delta_frac
FROM customer_panel"""))
def deltas(spark, sf_dir):
    return rounded(customer_panel(spark, sf_dir))


@query("pnl04_coverage_scoreboard", sql("customer_long", """
SELECT category, CAST(count(DISTINCT indicator) AS BIGINT) AS n_indicators, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT period) AS BIGINT) AS n_periods,
       round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS share_value_na,
       round(avg(CASE WHEN reported_pct IS NULL THEN 1.0 ELSE 0.0 END), 9) AS share_reported_na
FROM customer_long GROUP BY 1"""))
def scoreboard(spark, sf_dir):
    return rounded(quality.coverage_scoreboard(customer_long(spark, sf_dir)))


@query("pnl05_indicator_contract", sql("customer_long", f"""
SELECT category, indicator, unit, CAST(count(*) AS BIGINT) AS n_rows,
       string_agg(DISTINCT CAST(period AS VARCHAR), ';' ORDER BY CAST(period AS VARCHAR)) AS periods,
       bool_or(period = {BASE}) AS has_{BASE}, bool_or(period = {CURRENT}) AS has_{CURRENT},
       round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS share_value_na,
       round(avg(CASE WHEN reported_pct IS NULL THEN 1.0 ELSE 0.0 END), 9) AS share_reported_na
FROM customer_long GROUP BY 1, 2, 3"""))
def contract(spark, sf_dir):
    return rounded(quality.indicator_contract(customer_long(spark, sf_dir), PERIODS))


@query("pnl06_indicator_dictionary", sql("customer_long", """
SELECT DISTINCT category, indicator, unit FROM customer_long"""))
def dictionary(spark, sf_dir):
    return quality.indicator_dictionary(customer_long(spark, sf_dir))


@query("pnl07_ingest_profile", sql("nation_long", """
SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM nation_long
UNION ALL SELECT 'cols', CAST(5 AS DOUBLE)
UNION ALL SELECT 'n_categories', CAST(count(DISTINCT category) AS DOUBLE) FROM nation_long
UNION ALL SELECT 'n_indicators', CAST(count(DISTINCT indicator) AS DOUBLE) FROM nation_long
UNION ALL SELECT 'checksum', sum(CASE WHEN indicator = 'NATION_3' AND period = 2000 THEN value END) FROM nation_long"""))
def profile(spark, sf_dir):
    return metrics.metrics_long(quality.ingest_profile(nation_long(spark, sf_dir), "NATION_3", CURRENT))


@query("pnl08_contract_drift", """
WITH now AS (SELECT DISTINCT c_mktsegment AS category, c_name AS indicator FROM orders
             JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
     snap AS (SELECT DISTINCT c_mktsegment AS category, c_name AS indicator FROM orders
             JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F')
SELECT category, indicator, 'added' AS status FROM (SELECT * FROM now EXCEPT SELECT * FROM snap)
UNION ALL
SELECT category, indicator, 'removed' AS status FROM (SELECT * FROM snap EXCEPT SELECT * FROM now)""")
def drift(spark, sf_dir):
    """Customers with finished orders against customers with any other order."""
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("indicator")
    )

    def side(chosen):
        keys = table(spark, sf_dir, "orders").filter(chosen).select("o_custkey").distinct()
        return names.join(keys, "o_custkey", "left_semi")

    return quality.contract_drift(side(F.col("o_orderstatus") == "F"), side(F.col("o_orderstatus") != "F"), ["category", "indicator"])


@query("pnl08_snapshot_drift", """
WITH now AS (SELECT o_orderkey, o_orderstatus FROM orders),
     snap AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT o_orderkey, o_orderstatus, 'added' AS status FROM (SELECT * FROM now EXCEPT SELECT * FROM snap)
UNION ALL
SELECT o_orderkey, o_orderstatus, 'removed' AS status FROM (SELECT * FROM snap EXCEPT SELECT * FROM now)""")
def snapshot_drift(spark, sf_dir):
    """All orders with their status against a snapshot from before any was partly shipped."""
    now = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    earlier = F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))
    return quality.snapshot_drift(now, now.withColumn("o_orderstatus", earlier), ["o_orderkey", "o_orderstatus"])


@query("pnl09_duplicate_keys", """
SELECT l_partkey, l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS period, CAST(count(*) AS BIGINT) AS n_rows
FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def duplicates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("period", F.year("l_shipdate"))
    return quality.duplicate_keys(lines, ["l_partkey", "l_suppkey", "period"])
