"""Composite index over the part panel."""

from pyspark.sql import functions as F

from panelwright.operators import composite, metrics
from panelwright.presets import Dimension
from registered.base import cte, customer_panel, part_panel, query, rounded, sql

KEYS = ["entity", "category", "indicator"]
DIMENSIONS = (
    Dimension("control", "hot|cold", ("PROMO",)),
    Dimension("innov", "ring|bolt"),
    Dimension("dispute", "gear|widget", ("ECONOMY",), mode="all"),
)

cte("features", ("part_panel",), """
SELECT *, coalesce(CASE WHEN delta_abs < 0 THEN 0 ELSE delta_abs END, 0) AS delta_pos,
       coalesce(abs(delta_abs), abs(delta_frac)) AS shock, value_current AS stock FROM part_panel""")
cte("index_totals", ("features",), "SELECT sum(stock) AS stock_total, sum(delta_pos) AS growth_total FROM features")
cte("scored", ("features", "index_totals"), r"""
SELECT f.*, CASE WHEN stock_total > 0 AND stock IS NOT NULL THEN stock / stock_total ELSE 0 END AS stock_share,
       CASE WHEN growth_total > 0 THEN delta_pos / growth_total ELSE 0 END AS growth_share,
       CAST(category = 'PROMO' OR regexp_matches(lower(indicator), 'hot|cold') AS INTEGER) AS is_control,
       CAST(regexp_matches(lower(indicator), 'ring|bolt') AS INTEGER) AS is_innov,
       CAST(category = 'ECONOMY' AND regexp_matches(lower(indicator), 'gear|widget') AS INTEGER) AS is_dispute,
       coalesce(abs(delta_abs), abs(value_current), abs(delta_frac)) AS severity
FROM features f CROSS JOIN index_totals""")
cte("raw_scores_table", ("scored",), """
SELECT *, is_control * severity AS score_control, is_innov * severity AS score_innov,
       is_dispute * severity AS score_dispute FROM scored""")
COMPONENTS = {"control": "score_control", "innov": "score_innov", "dispute": "score_dispute", "shock": "shock",
              "stock": "stock_share", "growth": "growth_share"}
cte("score_limits", ("raw_scores_table",), "SELECT " + ", ".join(
    f"min({c}) AS low_{n}, max({c}) AS high_{n}" for n, c in COMPONENTS.items()) + " FROM raw_scores_table")
cte("rescaled", ("raw_scores_table", "score_limits"), "SELECT r.*, " + ", ".join(
    f"CASE WHEN low_{n} IS NULL OR low_{n} = high_{n} THEN 0 ELSE ({c} - low_{n}) / (high_{n} - low_{n}) END AS component_{n}"
    for n, c in COMPONENTS.items()) + " FROM raw_scores_table r CROSS JOIN score_limits")
cte("composite", ("rescaled",), """
SELECT *, delta_abs IS NOT NULL OR delta_frac IS NOT NULL AS has_delta,
       CASE WHEN delta_abs IS NOT NULL OR delta_frac IS NOT NULL
         THEN coalesce(component_control, 0) * CAST(0.40 AS DOUBLE) + coalesce(component_innov, 0) * CAST(0.25 AS DOUBLE)
            + coalesce(component_dispute, 0) * CAST(0.20 AS DOUBLE) + coalesce(component_shock, 0) * CAST(0.15 AS DOUBLE)
         ELSE least(coalesce(component_stock, 0) * CAST(0.05 AS DOUBLE), CAST(0.08 AS DOUBLE)) END AS composite
FROM rescaled""")
cte("typed", ("composite",), """
SELECT *, CASE WHEN component_control >= CAST(0.60 AS DOUBLE) AND component_shock >= CAST(0.30 AS DOUBLE) THEN 'Control social + shock'
         WHEN component_innov >= CAST(0.50 AS DOUBLE) THEN 'Innovación táctica'
         WHEN component_dispute >= CAST(0.50 AS DOUBLE) THEN 'Competencia/Disputa'
         WHEN component_stock >= CAST(0.50 AS DOUBLE) THEN 'Dominante por nivel (stock)' ELSE 'Mixto' END AS typology,
       CASE WHEN composite >= CAST(0.70 AS DOUBLE) THEN 'Alta Prioridad'
         WHEN composite >= CAST(0.40 AS DOUBLE) THEN 'Media Prioridad' ELSE 'Baja Prioridad' END AS priority
FROM composite""")


def index_table(spark, sf_dir):
    return composite.composite_table(part_panel(spark, sf_dir), DIMENSIONS)


def scored(spark, sf_dir):
    flagged = composite.keyword_flags(composite.change_features(part_panel(spark, sf_dir)), DIMENSIONS)
    return composite.dimension_scores(composite.severity(flagged))


@query("idx01_change_features", sql("features", """
SELECT entity, category, indicator, delta_pos, round(shock, 9) AS shock, stock FROM features"""))
def features(spark, sf_dir):
    return rounded(composite.change_features(part_panel(spark, sf_dir)).select(*KEYS, "delta_pos", "shock", "stock"))


@query("idx02_global_shares", sql("scored", """
SELECT entity, round(stock_share, 12) AS stock_share, round(growth_share, 12) AS growth_share FROM scored"""))
def shares(spark, sf_dir):
    table = composite.global_shares(composite.change_features(part_panel(spark, sf_dir)))
    return rounded(table.select("entity", "stock_share", "growth_share"), 12)


@query("idx03_keyword_flags", sql("scored", "SELECT entity, is_control, is_innov, is_dispute FROM scored"))
def flags(spark, sf_dir):
    table = composite.keyword_flags(part_panel(spark, sf_dir), DIMENSIONS)
    return table.select("entity", "is_control", "is_innov", "is_dispute")


@query("idx04_severity", sql("scored", "SELECT entity, round(severity, 9) AS severity FROM scored"))
def severities(spark, sf_dir):
    return rounded(composite.severity(part_panel(spark, sf_dir)).select("entity", "severity"))


@query("idx05_dimension_scores", sql("raw_scores_table", """
SELECT entity, round(score_control, 9) AS score_control, round(score_innov, 9) AS score_innov,
       round(score_dispute, 9) AS score_dispute FROM raw_scores_table"""))
def dimension_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("entity", "score_control", "score_innov", "score_dispute"))


@query("idx06_safe_rescale", sql("rescaled", "SELECT entity, " + ", ".join(
    f"round(component_{n}, 9) AS component_{n}" for n in COMPONENTS) + " FROM rescaled"))
def rescaled(spark, sf_dir):
    shared = composite.global_shares(composite.change_features(part_panel(spark, sf_dir)))
    raw = composite.dimension_scores(composite.severity(composite.keyword_flags(shared, DIMENSIONS)))
    table = composite.safe_rescale(raw, composite.COMPONENTS)
    return rounded(table.select("entity", *composite.COMPONENTS))


@query("idx06_safe_rescale_by_group", sql("raw_scores_table", """
SELECT entity, category, round(CASE WHEN min(shock) OVER w IS NULL OR min(shock) OVER w = max(shock) OVER w THEN 0
         ELSE (shock - min(shock) OVER w) / (max(shock) OVER w - min(shock) OVER w) END, 9) AS shock_scaled
FROM raw_scores_table WINDOW w AS (PARTITION BY category)"""))
def rescaled_by_group(spark, sf_dir):
    table = composite.safe_rescale(scored(spark, sf_dir), {"shock_scaled": "shock"}, by=["category"])
    return rounded(table.select("entity", "category", "shock_scaled"))


@query("idx07_composite_index", sql("composite", """
SELECT entity, has_delta, round(composite, 9) AS composite FROM composite"""))
def index(spark, sf_dir):
    return rounded(index_table(spark, sf_dir).select("entity", "has_delta", "composite"))


@query("idx08_typology", sql("typed", "SELECT entity, typology FROM typed"))
def typology(spark, sf_dir):
    return index_table(spark, sf_dir).select("entity", "typology")


@query("idx09_priority", sql("typed", "SELECT entity, priority FROM typed"))
def priority(spark, sf_dir):
    return index_table(spark, sf_dir).select("entity", "priority")


@query("idx10_ranked_index_table", sql("typed", """
SELECT entity, category, indicator, CAST(round_even(composite, 3) AS DOUBLE) AS idx, typology, delta_abs,
       round(delta_frac, 9) AS delta_frac FROM typed"""))
def ranked(spark, sf_dir):
    return rounded(composite.ranked_index_table(index_table(spark, sf_dir), KEYS))


@query("idx11_summary_by_type", sql("typed", """
SELECT typology, priority, CAST(count(*) AS BIGINT) AS n, coalesce(sum(stock), 0) AS sum_stock,
       coalesce(sum(delta_abs), 0) AS sum_delta_net, coalesce(sum(delta_pos), 0) AS sum_delta_pos,
       round(avg(composite), 9) AS avg_idx FROM typed GROUP BY 1, 2"""))
def summary(spark, sf_dir):
    return rounded(composite.summary_by_type(index_table(spark, sf_dir)))


@query("idx12_diagnostics", sql("typed", """
SELECT CAST(count(*) AS BIGINT) AS n_indicators, CAST(count(*) - count(composite) AS BIGINT) AS n_na_idx,
       CAST(count(*) - count(delta_abs) AS BIGINT) AS n_na_delta, CAST(count(*) - count(value_base) AS BIGINT) AS n_na_base,
       CAST(count(*) - count(value_current) AS BIGINT) AS n_na_current, sum(delta_abs) AS sum_net, sum(delta_pos) AS sum_pos
FROM typed"""))
def diagnostics(spark, sf_dir):
    return composite.diagnostics(index_table(spark, sf_dir))


@query("idx13_top_dynamic", sql("typed", """
SELECT entity, category, indicator, CAST(round_even(composite, 3) AS DOUBLE) AS idx, typology, delta_abs,
       round(delta_frac, 9) AS delta_frac FROM typed WHERE has_delta
ORDER BY composite DESC, entity, category, indicator LIMIT 10"""))
def dynamic(spark, sf_dir):
    return rounded(composite.top_dynamic(index_table(spark, sf_dir), KEYS))


LEGACY = {"component_control": 0.35, "component_innov": 0.20, "component_dispute": 0.20, "component_shock": 0.15,
          "component_growth": 0.05, "component_stock": 0.05}


@query("idx14_legacy_index", sql("rescaled", "SELECT entity, round(" + " + ".join(
    f"component_{c.split('_')[1]} * CAST({w} AS DOUBLE)" for c, w in LEGACY.items()) + ", 9) AS legacy FROM rescaled"))
def legacy(spark, sf_dir):
    return rounded(composite.weighted_sum(index_table(spark, sf_dir), LEGACY, "legacy").select("entity", "legacy"))


K, ROUNDS = 5, 50
_X = [f"x{i}" for i in range(len(composite.COMPONENTS))]
_POINT = ", ".join(f"CAST(floor(coalesce({c}, 0) * 1000000 + 0.5) AS BIGINT) AS {x}" for c, x in zip(composite.COMPONENTS, _X))
cte("cluster_points", ("composite",), f"""
SELECT {', '.join(_X)}, count(*) AS n, md5(concat_ws(',', {', '.join(_X)})) AS digest
FROM (SELECT {_POINT} FROM composite) GROUP BY {', '.join(_X)}""")


def _apart(centre: str) -> str:
    return " + ".join(f"(p.{x} - {centre.format(x=x)}) * (p.{x} - {centre.format(x=x)})" for x in _X)


_LABELS = "[" + ", ".join(_apart(f"c{j}_{{x}}") for j in range(1, K + 1)) + "]"
_SEEDS = ",\n".join(
    [f"s1 AS MATERIALIZED (SELECT {', '.join(_X)} FROM cluster_points ORDER BY digest LIMIT 1)"] + [
        f"s{j} AS MATERIALIZED (SELECT {', '.join('p.' + x for x in _X)} FROM cluster_points p, "
        f"{', '.join(f's{i}' for i in range(1, j))} ORDER BY least({', '.join(_apart(f's{i}.{{x}}') for i in range(1, j))}) DESC, "
        "p.digest LIMIT 1)" for j in range(2, K + 1)])
_FIRST = ", ".join(f"s{j}.{x} AS c{j}_{x}" for j in range(1, K + 1) for x in _X)
_MOVED = ", ".join(
    f"coalesce(CAST(sum(n * {x}) FILTER (label = {j}) // sum(n) FILTER (label = {j}) AS BIGINT), any_value(c{j}_{x})) AS c{j}_{x}"
    for j in range(1, K + 1) for x in _X)


@query("idx15_cluster_indicators", sql("cluster_points", f"""
WITH {_SEEDS},
lloyd AS (
  SELECT 0 AS round, {_FIRST} FROM {', '.join(f's{j}' for j in range(1, K + 1))}
  UNION ALL
  SELECT round + 1 AS round, {_MOVED}
  FROM (SELECT p.*, l.*, list_position({_LABELS}, list_min({_LABELS})) AS label
        FROM lloyd l, cluster_points p WHERE round < {ROUNDS}) GROUP BY round)
SELECT entity, round(composite, 9) AS composite, {', '.join(f'round({c}, 9) AS {c}' for c in composite.COMPONENTS)},
       CAST(list_position({_LABELS}, list_min({_LABELS})) AS INTEGER) AS cluster
FROM (SELECT *, {_POINT} FROM composite) p, (SELECT * FROM lloyd WHERE round = {ROUNDS})""", recursive=True))
def clusters(spark, sf_dir):
    table = index_table(spark, sf_dir).select("entity", "composite", *composite.COMPONENTS)
    return rounded(composite.cluster_indicators(table, list(composite.COMPONENTS), K, rounds=ROUNDS))


CENTRES = [[0.0] * 4, [0.5, 0.0, 0.0, 0.0], [0.0, 0.0, 0.001, 0.0], [0.0, 0.0, 0.0, 0.001], [0.25, 0.001, 0.0005, 0.5]]
_DISTANCES = [" + ".join(f"power(coalesce({c}, 0) - {x!r}, 2)" for c, x in zip(composite.COMPONENTS, centre)) for centre in CENTRES]


@query("idx15b_assign_clusters", sql("composite", f"""
SELECT entity, CAST(list_position(d, list_min(d)) AS INTEGER) AS cluster
FROM (SELECT entity, [{', '.join(_DISTANCES)}] AS d FROM composite)"""))
def assigned(spark, sf_dir):
    """The nearest of given centres."""
    table = index_table(spark, sf_dir).select("entity", *composite.COMPONENTS)
    return composite.assign_clusters(table, CENTRES, list(composite.COMPONENTS)).select("entity", "cluster")


MEANS = {"avg_index": "composite", "share_control": "is_control", "share_innov": "is_innov",
         "share_dispute": "is_dispute", "avg_shock": "component_shock", "avg_growth": "growth_share",
         "avg_stock": "stock_share"}


@query("idx16_cluster_profiles", sql("composite", """
SELECT entity % 5 + 1 AS cluster, CAST(count(*) AS BIGINT) AS n_indicators, """ + ", ".join(
    f"round(avg({c}), 9) AS {n}" for n, c in MEANS.items()) + " FROM composite GROUP BY 1"))
def profiles(spark, sf_dir):
    """Given labels: the part key modulo five."""
    table = index_table(spark, sf_dir).withColumn("cluster", F.col("entity") % 5 + 1)
    return rounded(composite.cluster_profiles(table, MEANS))


cte("metric_sorted", ("customer_panel",), """
SELECT x, kind, row_number() OVER (PARTITION BY kind ORDER BY x) AS i, count(*) OVER (PARTITION BY kind) AS n,
       sum(x) OVER (PARTITION BY kind) AS s
FROM (SELECT CASE WHEN delta_abs < 0 THEN 0 ELSE delta_abs END AS x, 'growth_pos' AS kind FROM customer_panel
      UNION ALL SELECT value_current, 'stock_current' FROM customer_panel) WHERE x IS NOT NULL""")


@query("idx17_index_metrics", sql("metric_sorted", """
SELECT 'n_indicators' AS metric, CAST(count(*) AS DOUBLE) AS value FROM customer_panel
UNION ALL SELECT 'n_positive_growth', CAST(count(*) AS DOUBLE) FROM customer_panel WHERE delta_abs > 0
UNION ALL SELECT 'sum_pos', sum(delta_abs) FROM customer_panel WHERE delta_abs > 0
UNION ALL SELECT 'sum_net', sum(delta_abs) FROM customer_panel
UNION ALL SELECT 'gini_' || kind, round(2 * sum(i * x) / (max(n) * max(s)) - (max(n) + 1) / CAST(max(n) AS DOUBLE), 6)
  FROM metric_sorted GROUP BY kind
UNION ALL SELECT 'hhi_' || kind, round(10000 * sum(x * x) / (max(s) * max(s)), 6) FROM metric_sorted GROUP BY kind"""))
def index_metrics(spark, sf_dir):
    return rounded(metrics.metrics_long(composite.index_metrics(customer_panel(spark, sf_dir))), 6)
