"""Markets, shares, ranks and concentration indices."""

from pyspark.sql import functions as F

from panelwright.operators import concentration as con, shares
from panelwright.operators.panel import latest_period
from panelwright.operators.ranking import top_k_per_group
from registered.base import (
    BASE, CURRENT, PERIODS, cte, customer_panel, nation_long, order_values, query, rounded, ship_years, sql,
    supplier_panel, table,
)

KEYS = ["category", "indicator", "unit"]


def customer_markets(spark, sf_dir):
    return shares.indicator_markets(customer_panel(spark, sf_dir), KEYS)


def supplier_markets(spark, sf_dir, periods=None):
    return shares.unpivot_markets(
        supplier_panel(spark, sf_dir, periods), ["actor", "period"], shares.ACTOR_MARKETS
    )


def supplier_shares(spark, sf_dir, periods=None):
    return shares.market_shares(supplier_markets(spark, sf_dir, periods), ["period", "market"], ties="min")


# --- indices in SQL, over any table (g..., x) ---------------------------------------

BUCKET = """CASE WHEN rank = 1 THEN 'Leader' WHEN rank <= 3 THEN 'Top 3' WHEN rank <= 5 THEN 'Top 5'
  WHEN rank <= 10 THEN 'Top 10' ELSE 'Others' END"""
ACTOR_BUCKET = BUCKET.replace("'Leader'", "'Market Leader'")
HHI_CASE = """CASE WHEN hhi IS NULL THEN NULL WHEN hhi < 1000 THEN 'No concentrado'
  WHEN hhi < 1800 THEN 'Moderadamente concentrado' WHEN hhi < 2500 THEN 'Concentrado'
  ELSE 'Altamente concentrado' END"""
TEXT_CASE = """CASE WHEN hhi IS NULL THEN NULL
  WHEN hhi < 1000 THEN 'Alta fragmentación - difícil negociar/contener por un solo vector'
  WHEN hhi < 1800 THEN 'Concentración moderada - hay vectores líderes explotables'
  WHEN hhi < 2500 THEN 'Oligopolio emergente - riesgo de dominancia de pocos vectores'
  ELSE 'Cuasi-monopolio - un shock domina; respuesta debe ser prioritaria y quirúrgica' END"""
ACTOR_TEXT_CASE = """CASE WHEN hhi IS NULL THEN NULL
  WHEN hhi < 1000 THEN 'Alta fragmentación - dificultad de negociación'
  WHEN hhi < 1800 THEN 'Competencia con líderes - oportunidad para ''divide y vencerás'''
  WHEN hhi < 2500 THEN 'Oligopolio emergente - riesgo de coordinación criminal'
  ELSE 'Cuasi-monopolio - requiere estrategia de desarticulación prioritaria' END"""

GINI = """CASE WHEN max(s) <= 0 THEN 0
  ELSE 2 * sum(i * x) / (max(n) * max(s)) - (max(n) + 1) / CAST(max(n) AS DOUBLE) END"""
PALMA = """CASE WHEN max(s) > 0 THEN
  sum(x) FILTER (d <= greatest(1, floor(n * CAST(0.1 AS DOUBLE))))
  / nullif(sum(x) FILTER (d >= ceil(n * CAST(0.6 AS DOUBLE))), 0) END"""
HHI = "CASE WHEN max(s) > 0 THEN 10000 * sum(x * x) / (max(s) * max(s)) END"


def dense(k):
    return f"CASE WHEN max(s) > 0 THEN 100 * coalesce(sum(x) FILTER (r <= {k}), 0) / max(s) ELSE 0 END"


def exact(k):
    return f"CASE WHEN max(s) > 0 THEN 100 * coalesce(sum(x) FILTER (d <= {k}), 0) / max(s) END"


cte("customer_sorted", ("customer_markets",), """
SELECT market, capacity AS x, row_number() OVER (PARTITION BY market ORDER BY capacity) AS i,
       row_number() OVER (PARTITION BY market ORDER BY capacity DESC) AS d,
       dense_rank() OVER (PARTITION BY market ORDER BY capacity DESC) AS r,
       count(*) OVER (PARTITION BY market) AS n, sum(capacity) OVER (PARTITION BY market) AS s
FROM customer_markets""")
cte("supplier_sorted", ("supplier_markets",), """
SELECT period, market, capacity AS x, row_number() OVER (PARTITION BY period, market ORDER BY capacity) AS i,
       row_number() OVER (PARTITION BY period, market ORDER BY capacity DESC) AS d,
       dense_rank() OVER (PARTITION BY period, market ORDER BY capacity DESC) AS r,
       count(*) OVER (PARTITION BY period, market) AS n, sum(capacity) OVER (PARTITION BY period, market) AS s
FROM supplier_markets""")


@query("con01_unpivot_markets", sql("customer_markets", "SELECT * FROM customer_markets"))
def markets(spark, sf_dir):
    return customer_markets(spark, sf_dir)


@query("con01b_unpivot_actor_markets", sql("supplier_markets", "SELECT * FROM supplier_markets"))
def actor_markets(spark, sf_dir):
    return supplier_markets(spark, sf_dir)


cte("customer_ranked", ("customer_markets",), """
SELECT *, sum(capacity) OVER (PARTITION BY market) AS total_market,
       capacity / sum(capacity) OVER (PARTITION BY market) AS share,
       CAST(dense_rank() OVER (PARTITION BY market ORDER BY capacity DESC) AS BIGINT) AS rank
FROM customer_markets""")


@query("con02_market_shares", sql("customer_ranked", """
SELECT category, indicator, market, capacity, total_market, round(share, 12) AS share, rank FROM customer_ranked"""))
def market_shares(spark, sf_dir):
    table = shares.market_shares(customer_markets(spark, sf_dir), ["market"])
    return rounded(table.drop("unit", "bucket"), 12)


@query("con02b_actor_shares", sql("supplier_shares", f"""
SELECT actor, period, market, capacity, round(share, 12) AS share, rank, {ACTOR_BUCKET} AS bucket
FROM supplier_shares"""))
def actor_shares(spark, sf_dir):
    return rounded(supplier_shares(spark, sf_dir).drop("total_market"), 12)


@query("con03_share_bucket", sql("customer_ranked", f"""
SELECT market, {BUCKET} AS bucket, CAST(count(*) AS BIGINT) AS n, sum(capacity) AS capacity
FROM customer_ranked GROUP BY 1, 2"""))
def buckets(spark, sf_dir):
    return shares.bucket_totals(customer_markets(spark, sf_dir), ["market"])


@query("con04_gini", sql("customer_sorted", f"""
SELECT market, round({GINI}, 9) AS gini FROM customer_sorted GROUP BY 1"""))
def gini(spark, sf_dir):
    return rounded(con.gini(customer_markets(spark, sf_dir), ["market"], "capacity"))


@query("con04_gini_lines", """
WITH r AS (SELECT l_returnflag AS flag, l_quantity AS x,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS i,
       count(*) OVER (PARTITION BY l_returnflag) AS n, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS s
     FROM lineitem)
SELECT flag, round(""" + GINI + ", 9) AS gini FROM r GROUP BY 1")
def gini_lines(spark, sf_dir):
    """Over every line: three groups with a handful of distinct values."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return rounded(con.gini(lines, ["flag"], "l_quantity"))


@query("con04_gini_prices", """
WITH t AS (SELECT l_returnflag AS flag, CAST(round(l_extendedprice * 100) AS BIGINT) AS x FROM lineitem),
     r AS (SELECT flag, CAST(x AS DOUBLE) AS x, row_number() OVER (PARTITION BY flag ORDER BY x) AS i,
       count(*) OVER (PARTITION BY flag) AS n, sum(CAST(x AS DOUBLE)) OVER (PARTITION BY flag) AS s FROM t)
SELECT flag, round(""" + GINI + ", 9) AS gini FROM r GROUP BY 1")
def gini_prices(spark, sf_dir):
    """Over every line: three groups whose values are nearly all different."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.round(F.col("l_extendedprice") * 100).alias("price")
    )
    return rounded(con.gini(lines, ["flag"], "price"))


@query("con04b_actor_gini", sql("supplier_sorted", f"""
SELECT period, market, round({GINI}, 9) AS gini FROM supplier_sorted GROUP BY 1, 2"""))
def actor_gini(spark, sf_dir):
    return rounded(con.gini(supplier_markets(spark, sf_dir), ["period", "market"], "capacity"))


@query("con05_palma", sql("customer_sorted", f"""
SELECT market, round({PALMA}, 9) AS palma FROM customer_sorted GROUP BY 1"""))
def palma(spark, sf_dir):
    return rounded(con.palma(customer_markets(spark, sf_dir), ["market"], "capacity"))


@query("con06_hhi", sql("customer_sorted", f"""
SELECT market, CAST(count(*) AS BIGINT) AS n, sum(x) AS total, round({HHI}, 6) AS hhi FROM customer_sorted GROUP BY 1"""))
def hhi(spark, sf_dir):
    return rounded(con.hhi(customer_markets(spark, sf_dir), ["market"], "capacity"), 6)


@query("con07_effective_n", sql("supplier_sorted", f"""
SELECT period, market, round(10000 / nullif({HHI}, 0), 6) AS effective_n FROM supplier_sorted GROUP BY 1, 2"""))
def effective(spark, sf_dir):
    table = con.hhi(supplier_markets(spark, sf_dir), ["period", "market"], "capacity")
    return rounded(table.select("period", "market", con.effective_n(F.col("hhi")).alias("effective_n")), 6)


@query("con08_cr_dense", sql("customer_sorted", f"""
SELECT market, round({dense(3)}, 6) AS cr3, round({dense(5)}, 6) AS cr5 FROM customer_sorted GROUP BY 1"""))
def cr_dense(spark, sf_dir):
    return rounded(con.concentration_ratios(customer_markets(spark, sf_dir), ["market"], "capacity"), 6)


@query("con08b_cr_row", sql("supplier_sorted", f"""
SELECT period, market, round({exact(3)}, 6) AS cr3, round({exact(5)}, 6) AS cr5 FROM supplier_sorted GROUP BY 1, 2"""))
def cr_row(spark, sf_dir):
    return rounded(con.concentration_ratios(
        supplier_markets(spark, sf_dir), ["period", "market"], "capacity", ties="row"
    ), 6)


@query("con08c_cumulative_share", sql("supplier_markets", """
SELECT actor, period, market, capacity, round(
  sum(capacity) OVER (PARTITION BY period, market ORDER BY capacity DESC, md5(CAST(actor AS VARCHAR))
                      ROWS UNBOUNDED PRECEDING)
  / sum(capacity) OVER (PARTITION BY period, market), 12) AS cum_share FROM supplier_markets"""))
def cumulative(spark, sf_dir):
    rows = supplier_markets(spark, sf_dir)
    return rounded(shares.cumulative_shares(rows, ["period", "market"], "capacity", ["actor"]), 12)


cte("customer_hhi", ("customer_panel",), """
SELECT category, 10000 * sum(value_current * value_current) / (sum(value_current) * sum(value_current)) AS hhi
FROM customer_panel GROUP BY 1
UNION ALL SELECT CAST(l_suppkey AS VARCHAR) AS category,
  10000 * sum(q * q) / (sum(q) * sum(q)) AS hhi
FROM (SELECT l_suppkey, l_linenumber, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT c_name AS category, 10000 * sum(v * v) / (sum(v) * sum(v)) AS hhi
FROM (SELECT c_name, o_orderpriority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS v
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1""")


@query("con09_hhi_bands", sql("customer_hhi", f"""
SELECT category, round(hhi, 6) AS hhi, {HHI_CASE} AS hhi_category, {TEXT_CASE} AS implication FROM customer_hhi"""))
def bands(spark, sf_dir):
    """Segments, suppliers by line number, customers by order priority: every band occurs."""
    segments = con.hhi(customer_panel(spark, sf_dir), ["category"], "value_current")
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("category"), "l_linenumber"
    ).agg(F.sum("l_quantity").alias("q"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("v")
    )
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("category")
    )
    customers = con.hhi(orders.join(names, "o_custkey"), ["category"], "v")
    all_hhi = segments.unionByName(con.hhi(lines, ["category"], "q")).unionByName(customers)
    level = F.col("hhi")
    return rounded(all_hhi.select(
        "category", "hhi", con.hhi_category(level).alias("hhi_category"),
        con.hhi_implication(level).alias("implication"),
    ), 6)


cte("customer_indices", ("customer_sorted",), f"""
SELECT market, CAST(max(n) AS BIGINT) AS n, max(s) AS total, {HHI} AS hhi, {dense(3)} AS cr3, {dense(5)} AS cr5,
       {GINI} AS gini, {PALMA} AS palma FROM customer_sorted GROUP BY 1""")
cte("supplier_indices", ("supplier_sorted",), f"""
SELECT period, market, CAST(max(n) AS BIGINT) AS n, max(s) AS total, {HHI} AS hhi, {exact(3)} AS cr3,
       {exact(5)} AS cr5, {GINI} AS gini, {PALMA} AS palma FROM supplier_sorted GROUP BY 1, 2""")

INDEX_COLUMNS = """n, total, round(hhi, 6) AS hhi, round(10000 / hhi, 6) AS effective_n, round(cr3, 6) AS cr3,
       round(cr5, 6) AS cr5, round(gini, 6) AS gini, round(palma, 6) AS palma"""


@query("con10_concentration_indices", sql("customer_indices", f"""
SELECT market, {INDEX_COLUMNS}, {HHI_CASE} AS hhi_category, {TEXT_CASE} AS implication FROM customer_indices"""))
def indices(spark, sf_dir):
    return rounded(con.concentration_indices(customer_markets(spark, sf_dir), ["market"], "capacity"), 6)


def actor_indices(spark, sf_dir, periods=None):
    return con.concentration_indices(
        supplier_markets(spark, sf_dir, periods), ["period", "market"], "capacity", ties="row", variant="actor"
    )


@query("con10b_actor_indices", sql("supplier_indices", f"""
SELECT period, market, {INDEX_COLUMNS}, {HHI_CASE} AS hhi_category, {ACTOR_TEXT_CASE} AS implication
FROM supplier_indices"""))
def actor_index_table(spark, sf_dir):
    return rounded(actor_indices(spark, sf_dir), 6)


@query("con11_market_label", sql("customer_sorted", """
SELECT market, CASE market WHEN 'stock_base' THEN 'Level 1999' WHEN 'stock_current' THEN 'Level 2000'
       ELSE market END AS market_label, CAST(count(*) AS BIGINT) AS n FROM customer_sorted GROUP BY 1"""))
def labels(spark, sf_dir):
    counts = customer_markets(spark, sf_dir).groupBy("market").agg(F.count(F.lit(1)).alias("n"))
    return con.label_markets(counts, {"stock_base": "Level 1999", "stock_current": "Level 2000"})


@query("con12_top_by_market", sql("customer_ranked", f"""
SELECT market, category, indicator, unit, capacity, round(share, 12) AS share, rank, {BUCKET} AS bucket
FROM customer_ranked
QUALIFY row_number() OVER (PARTITION BY market ORDER BY capacity DESC, category, indicator, unit) <= 10"""))
def top_by_market(spark, sf_dir):
    measures = shares.indicator_measures(customer_panel(spark, sf_dir), KEYS)
    return rounded(shares.top_by_market(measures, KEYS, shares.INDICATOR_MARKETS), 12)


@query("con12_top_k_per_group", """
SELECT l_returnflag AS flag, l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(place AS BIGINT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag
           ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS place FROM lineitem)
WHERE place <= 10""")
def top_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "l_quantity",
    )
    order = [F.col("l_quantity").desc(), *[F.col(c) for c in (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]]
    top = top_k_per_group(lines, ["flag"], order, 10)
    return top.select("flag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                      F.col("place").cast("bigint").alias("place"))


@query("con13_hhi_trend", sql("supplier_indices", """
SELECT period, market, round(hhi, 6) AS hhi,
       round(hhi - lag(hhi) OVER (PARTITION BY market ORDER BY period), 6) AS hhi_trend FROM supplier_indices"""))
def trend(spark, sf_dir):
    table = con.hhi(supplier_markets(spark, sf_dir), ["period", "market"], "capacity")
    return rounded(con.hhi_trend(table).select("period", "market", "hhi", "hhi_trend"), 6)


@query("con13_hhi_trend_region", sql("nation_long", """
WITH h AS (SELECT category, period, 10000 * sum(value * value) / (sum(value) * sum(value)) AS hhi
           FROM nation_long GROUP BY 1, 2)
SELECT category, period, round(hhi, 6) AS hhi,
       round(hhi - lag(hhi) OVER (PARTITION BY category ORDER BY period), 6) AS hhi_trend FROM h"""))
def trend_region(spark, sf_dir):
    table = con.hhi(nation_long(spark, sf_dir), ["category", "period"], "value")
    trended = con.hhi_trend(table, ["category"])
    return rounded(trended.select("category", "period", "hhi", "hhi_trend"), 6)


cte("share_pairs", ("supplier_shares",), f"""
SELECT actor, market, max(CASE WHEN period = {BASE} THEN share END) AS share_base,
       max(CASE WHEN period = {CURRENT} THEN share END) AS share_current,
       max(CASE WHEN period = {BASE} THEN rank END) AS rank_base,
       max(CASE WHEN period = {CURRENT} THEN rank END) AS rank_current
FROM supplier_shares WHERE period IN ({BASE}, {CURRENT}) GROUP BY 1, 2""")


@query("con14_share_evolution", sql("share_pairs", """
SELECT actor, market, round(share_base, 12) AS share_base, round(share_current, 12) AS share_current,
       round(share_current - share_base, 12) AS share_change,
       CASE WHEN share_current > share_base THEN 'Gained' WHEN share_current <= share_base THEN 'Lost' END AS change_direction,
       round(abs(share_current - share_base), 12) AS change_magnitude FROM share_pairs"""))
def evolution(spark, sf_dir):
    rows = shares.plain_shares(supplier_markets(spark, sf_dir, PERIODS), ["period", "market"])
    return rounded(shares.share_evolution(rows, BASE, CURRENT), 12)


MOBILITY = """CASE WHEN rank_base - rank_current > 2 THEN 'Significant Improvement'
  WHEN rank_base - rank_current > 0 THEN 'Slight Improvement' WHEN rank_base - rank_current = 0 THEN 'Stable'
  WHEN rank_base - rank_current > -2 THEN 'Slight Decline' ELSE 'Significant Decline' END"""


@query("con15_rank_mobility", sql("share_pairs", f"""
SELECT actor, market, rank_base, rank_current, rank_base - rank_current AS rank_change, {MOBILITY} AS mobility
FROM share_pairs"""))
def mobility(spark, sf_dir):
    rows = supplier_shares(spark, sf_dir, PERIODS)
    return shares.rank_mobility(rows, BASE, CURRENT, seen_in=ship_years(spark, sf_dir))


@query("con15b_rank_mobility_missing", sql("share_pairs", f"""
SELECT actor, market, rank_base, rank_current, rank_base - rank_current AS rank_change, {MOBILITY} AS mobility
FROM share_pairs WHERE EXISTS (SELECT 1 FROM supplier_panel WHERE period = 2050)"""))
def mobility_missing(spark, sf_dir):
    """The second period does not occur: no rows, same columns."""
    rows = supplier_shares(spark, sf_dir, PERIODS)
    return shares.rank_mobility(rows, BASE, 2050, seen_in=ship_years(spark, sf_dir))


# At the size of the tables no supplier holds 40 % of a market; the threshold is scaled down.
DOMINANT = 0.0105


@query("con16_dominance", sql("supplier_shares", f"""
WITH f AS (SELECT actor, market, capacity, share, rank, share > CAST({DOMINANT} AS DOUBLE) AS is_dominant
           FROM supplier_shares WHERE period = (SELECT max(period) FROM supplier_shares))
SELECT actor, market, capacity, round(share, 12) AS share, rank, is_dominant,
       round(max(share) FILTER (NOT is_dominant) OVER w / nullif(max(share) FILTER (is_dominant) OVER w, 0), 9) AS dominant_gap
FROM f WINDOW w AS (PARTITION BY market)"""))
def dominant(spark, sf_dir):
    years = ship_years(spark, sf_dir)
    last = latest_period(supplier_markets(spark, sf_dir), seen_in=years)
    ranked = shares.market_shares(last, ["period", "market"], ties="min")
    rows = shares.dominance(ranked, shares.ACTOR_MARKETS, DOMINANT, seen_in=years)
    return rows.select(
        "actor", "market", "capacity", F.round("share", 12).alias("share"), "rank", "is_dominant",
        F.round("dominant_gap", 9).alias("dominant_gap"),
    )


@query("con16_dominance_region", sql("nation_long", """
WITH l AS (SELECT category, indicator, value, value / sum(value) OVER (PARTITION BY category) AS share FROM nation_long
           WHERE period = (SELECT max(period) FROM nation_long)),
     f AS (SELECT *, share > CAST(0.21 AS DOUBLE) AS is_dominant FROM l)
SELECT category, indicator, round(share, 9) AS share, is_dominant,
       round(max(share) FILTER (NOT is_dominant) OVER w / nullif(max(share) FILTER (is_dominant) OVER w, 0), 9) AS dominant_gap
FROM f WINDOW w AS (PARTITION BY category)"""))
def dominant_region(spark, sf_dir):
    """Nations inside their region; the regions are the market list."""
    rows = shares.market_shares(nation_long(spark, sf_dir), ["category", "period"], "value", ties="min")
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    out = shares.dominance(rows, regions, 0.21, market="category", seen_in=order_values(spark, sf_dir))
    return rounded(out.select("category", "indicator", "share", "is_dominant", "dominant_gap"))


@query("con17_entry_barriers", sql("supplier_indices", """
WITH b AS (SELECT period, market, hhi, CASE WHEN hhi > 2500 THEN 'Very High' WHEN hhi > 1800 THEN 'High'
             WHEN hhi > 1000 THEN 'Moderate' ELSE 'Low' END AS barrier
           FROM supplier_indices WHERE period = (SELECT max(period) FROM supplier_indices))
SELECT period, market, round(hhi, 6) AS hhi, barrier,
       CASE barrier WHEN 'Very High' THEN 'Mercado cerrado a nuevos actores' WHEN 'High' THEN 'Alto costo de entrada'
            WHEN 'Moderate' THEN 'Entrada posible con recursos' ELSE 'Mercado abierto a competencia' END AS barrier_implication
FROM b"""))
def barriers(spark, sf_dir):
    table = con.hhi(supplier_markets(spark, sf_dir), ["period", "market"], "capacity")
    out = con.entry_barriers(table, seen_in=ship_years(spark, sf_dir))
    return rounded(out.select("period", "market", "hhi", "barrier", "barrier_implication"), 6)


@query("con18_hhi_range", sql("supplier_indices", """
SELECT CAST(round(min(hhi), 3) AS VARCHAR) || '-' || CAST(round(max(hhi), 3) AS VARCHAR) AS hhi_range
FROM supplier_indices"""))
def hhi_range(spark, sf_dir):
    return con.hhi_range(con.hhi(supplier_markets(spark, sf_dir), ["period", "market"], "capacity"))
