"""Tables behind the charts."""

from panelwright.operators import figures, growth
from registered import composite, risk
from registered.base import customer_panel, query, rounded, sql


@query("fig1_top_movers", sql("growth", """
SELECT category, indicator, delta_abs, delta_pos, abs(delta_abs) AS abs_delta,
       CASE WHEN delta_abs IS NULL THEN 'NA' ELSE printf('%+g', delta_abs) END AS label
FROM growth ORDER BY abs(delta_abs) DESC NULLS LAST, category, indicator LIMIT 12"""))
def movers(spark, sf_dir):
    table = growth.growth_decomposition(customer_panel(spark, sf_dir))
    return figures.top_movers(table, ["category", "indicator"])


@query("fig2_top_index", sql("typed", """
SELECT entity, category, indicator, round(composite, 9) AS composite FROM typed
ORDER BY composite DESC NULLS LAST, entity, category, indicator LIMIT 12"""))
def top_index(spark, sf_dir):
    return rounded(figures.top_index(composite.index_table(spark, sf_dir), composite.KEYS))


@query("fig3_score_bars", sql("components", """
SELECT entity, code, CASE WHEN length(name) > 18 THEN substring(name, 1, 15) || '...' ELSE name END AS label,
       round(weighted_score, 9) AS weighted_score FROM components"""))
def bars(spark, sf_dir):
    return rounded(figures.score_bars(risk.components(spark, sf_dir), risk.ENTITY, width=18))
