"""Registration, and the panels over the given tables in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelwright.operators.panel import add_deltas, pivot_compare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE, CURRENT = 1999, 2000
PERIODS = [BASE, CURRENT]


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column, as the SQL does."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


# --- Spark panels -------------------------------------------------------------------


def order_values(spark, sf_dir, periods=None) -> DataFrame:
    """Customer key, year and cents of each order; the years become a date range in the scan."""
    orders = table(spark, sf_dir, "orders")
    if periods:
        date = F.col("o_orderdate")
        orders = orders.filter((date >= f"{min(periods)}-01-01") & (date < f"{max(periods) + 1}-01-01"))
    return orders.select("o_custkey", F.year("o_orderdate").alias("period"), cents("o_totalprice").alias("cents"))


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category"),
        F.col("c_name").alias("indicator"), "c_nationkey",
    )


def customer_long(spark, sf_dir, periods=None) -> DataFrame:
    """All or the given years per customer. Orders are summed per customer and year before the join."""
    sums = order_values(spark, sf_dir, periods).groupBy("o_custkey", "period").agg(
        F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("orders")
    )
    joined = sums.join(customers(spark, sf_dir), "o_custkey")
    per_name = joined.groupBy("category", "indicator", "period").agg(
        F.sum("cents").alias("cents"), F.sum("orders").alias("orders")
    )
    return per_name.select(
        "category", "indicator", "period",
        F.when(F.col("orders") < 4, F.col("cents").cast("double")).alias("value"),
        F.lit("cents").alias("unit"),
        F.when(F.col("orders") > 1, F.col("orders").cast("double")).alias("reported_pct"),
    )


def customer_panel(spark, sf_dir) -> DataFrame:
    """Two years per customer: summed and pivoted on the join key, so join and sum share a shuffle."""
    wide = pivot_compare(order_values(spark, sf_dir, PERIODS), BASE, CURRENT, ["o_custkey"],
                         value="cents", combine="sum")
    named = wide.join(customers(spark, sf_dir), "o_custkey")
    per_name = named.groupBy("category", "indicator", F.lit("cents").alias("unit")).agg(
        F.sum("value_base").alias("value_base"), F.sum("value_current").alias("value_current")
    )
    return add_deltas(per_name)


def part_panel(spark, sf_dir) -> DataFrame:
    """Two years of quantities per part, with the part's type and name."""
    date = F.col("l_shipdate")
    shipped = (
        table(spark, sf_dir, "lineitem")
        .filter((date >= f"{BASE}-01-01") & (date < f"{CURRENT + 1}-01-01"))
        .select("l_partkey", F.year(date).alias("period"), F.col("l_quantity").cast("bigint").alias("quantity"))
    )
    wide = pivot_compare(shipped, BASE, CURRENT, ["l_partkey"], value="quantity", combine="sum")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"), F.col("p_name").alias("indicator")
    )
    return add_deltas(wide.join(parts, "l_partkey").withColumnRenamed("l_partkey", "entity"))


def supplier_panel(spark, sf_dir, periods=None) -> DataFrame:
    """Quantities per supplier and year: all, returned, and the rest."""
    lines = table(spark, sf_dir, "lineitem")
    if periods:
        date = F.col("l_shipdate")
        lines = lines.filter((date >= f"{min(periods)}-01-01") & (date < f"{max(periods) + 1}-01-01"))
    quantity = F.col("l_quantity").cast("bigint")
    returned = F.when(F.col("l_returnflag") == "R", quantity).otherwise(F.lit(0))
    return (
        lines.groupBy(F.col("l_suppkey").alias("actor"), F.year("l_shipdate").alias("period"))
        .agg(F.sum(quantity).alias("total"), F.sum(returned).alias("armed"))
        .withColumn("support", F.col("total") - F.col("armed"))
    )


def ship_years(spark, sf_dir) -> DataFrame:
    """The years of the supplier panel, from one column of its source."""
    return table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("period"))


def user_panel(spark, sf_dir) -> DataFrame:
    """Events per user and kind in the two halves of January; a kind has a high and a low part."""
    level = F.when(F.col("value") >= 20, "high").otherwise("low")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"),
        level.alias("category"),
        F.concat_ws("_", "event_type", level).alias("indicator"),
        F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2).alias("period"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return add_deltas(pivot_compare(events, 1, 2, ["entity", "category", "indicator"], value="n", combine="sum"))


def nation_long(spark, sf_dir, periods=None) -> DataFrame:
    """All or the given years per nation. Region and nation are joined after the orders are summed."""
    sums = order_values(spark, sf_dir, periods).groupBy("o_custkey", "period").agg(F.sum("cents").alias("cents"))
    per_nation = (
        sums.join(customers(spark, sf_dir).select("o_custkey", "c_nationkey"), "o_custkey")
        .groupBy("c_nationkey", "period").agg(F.sum("cents").alias("cents"))
    )
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return per_nation.join(nation, "c_nationkey").join(region, "n_regionkey").select(
        F.col("r_name").alias("category"), F.col("n_name").alias("indicator"), "period",
        F.col("cents").cast("double").alias("value"), F.lit("cents").alias("unit"),
    )


# --- the same panels in SQL ------------------------------------------------------------

_CTES = {
    "customer_long": ((), """
SELECT c_mktsegment AS category, c_name AS indicator, CAST(year(o_orderdate) AS INTEGER) AS period,
       CASE WHEN count(*) < 4 THEN CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) END AS value,
       'cents' AS unit,
       CASE WHEN count(*) > 1 THEN CAST(count(*) AS DOUBLE) END AS reported_pct
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""),
    "customer_wide": ((), f"""
SELECT c_mktsegment AS category, c_name AS indicator, 'cents' AS unit,
       CAST(sum(CASE WHEN year(o_orderdate) = {BASE} THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) AS value_base,
       CAST(sum(CASE WHEN year(o_orderdate) = {CURRENT} THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) AS value_current
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE year(o_orderdate) IN ({BASE}, {CURRENT}) GROUP BY 1, 2, 3"""),
    "customer_panel": (("customer_wide",), """
SELECT *, value_current - value_base AS delta_abs,
       CASE WHEN value_base <> 0 THEN (value_current - value_base) / value_base END AS delta_frac
FROM customer_wide"""),
    "part_wide": ((), f"""
SELECT p_partkey AS entity, p_type AS category, p_name AS indicator,
       CAST(sum(CASE WHEN year(l_shipdate) = {BASE} THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) AS value_base,
       CAST(sum(CASE WHEN year(l_shipdate) = {CURRENT} THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) AS value_current
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE year(l_shipdate) IN ({BASE}, {CURRENT}) GROUP BY 1, 2, 3"""),
    "part_panel": (("part_wide",), """
SELECT *, value_current - value_base AS delta_abs,
       CASE WHEN value_base <> 0 THEN (value_current - value_base) / value_base END AS delta_frac
FROM part_wide"""),
    "supplier_all": ((), """
SELECT l_suppkey AS actor, CAST(year(l_shipdate) AS INTEGER) AS period,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS armed
FROM lineitem GROUP BY 1, 2"""),
    "supplier_panel": (("supplier_all",), "SELECT *, total - armed AS support FROM supplier_all"),
    "supplier_markets": (("supplier_panel",), """
SELECT actor, period, 'total' AS market, CAST(total AS DOUBLE) AS capacity FROM supplier_panel
UNION ALL SELECT actor, period, 'armed', CAST(armed AS DOUBLE) FROM supplier_panel
UNION ALL SELECT actor, period, 'support', CAST(support AS DOUBLE) FROM supplier_panel"""),
    "supplier_shares": (("supplier_markets",), """
SELECT *, CASE WHEN sum(capacity) OVER w > 0 THEN capacity / sum(capacity) OVER w ELSE 0 END AS share,
       CAST(rank() OVER (PARTITION BY period, market ORDER BY capacity DESC) AS BIGINT) AS rank
FROM supplier_markets WINDOW w AS (PARTITION BY period, market)"""),
    "customer_markets": (("customer_panel",), """
SELECT category, indicator, unit, 'stock_base' AS market, coalesce(value_base, 0) AS capacity FROM customer_panel
UNION ALL SELECT category, indicator, unit, 'stock_current', coalesce(value_current, 0) FROM customer_panel
UNION ALL SELECT category, indicator, unit, 'growth_pos',
       CASE WHEN coalesce(delta_abs, 0) < 0 THEN 0 ELSE coalesce(delta_abs, 0) END FROM customer_panel"""),
    "user_long": ((), """
SELECT user_id AS entity, CASE WHEN value >= 20 THEN 'high' ELSE 'low' END AS category,
       event_type || '_' || CASE WHEN value >= 20 THEN 'high' ELSE 'low' END AS indicator,
       CAST(sum(CASE WHEN day(ts) <= 15 THEN 1 END) AS DOUBLE) AS value_base,
       CAST(sum(CASE WHEN day(ts) > 15 THEN 1 END) AS DOUBLE) AS value_current
FROM events GROUP BY 1, 2, 3"""),
    "user_panel": (("user_long",), """
SELECT *, value_current - value_base AS delta_abs,
       CASE WHEN value_base <> 0 THEN (value_current - value_base) / value_base END AS delta_frac
FROM user_long"""),
    "nation_long": ((), """
SELECT r_name AS category, n_name AS indicator, CAST(year(o_orderdate) AS INTEGER) AS period,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS value, 'cents' AS unit
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""),
}


def cte(name: str, uses: tuple[str, ...], body: str) -> None:
    """Add a named sub-query for the SQL of several queries."""
    _CTES[name] = (uses, body)


def sql(uses: str | tuple[str, ...], body: str, recursive: bool = False) -> str:
    """``body`` with the named sub-queries it needs, each before its users."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _CTES[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in (uses,) if isinstance(uses, str) else uses:
        add(name)
    parts = ",\n".join(f"{name} AS ({_CTES[name][1].strip()})" for name in ordered)
    text = body.strip()
    if text.upper().startswith("WITH "):
        text = text[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{parts},\n{text}"
    return f"WITH {parts}\n{text}"
