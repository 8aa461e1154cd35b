"""The models, each from a panel to its named result tables, and a runner that writes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright import presets
from panelwright.operators import composite, concentration, figures, growth, panel as panels, quality, risk
from panelwright.operators import scenarios, shares
from panelwright.operators.metrics import metrics_long, run_metadata
from panelwright.operators.panel import PANEL_KEYS
from panelwright.sources import durable, standardize_actor, standardize_long, write_table

MODEL_VERSION = "1.0"


def panel_model(long: DataFrame, panel: DataFrame, periods: Sequence[int]) -> dict[str, DataFrame]:
    return {
        "panel_long": panels.long_panel(long),
        "panel_compare": panel,
        "panel_scoreboard": quality.coverage_scoreboard(long),
        "panel_contract": quality.indicator_contract(long, periods),
        "panel_dictionary": quality.indicator_dictionary(long),
    }


def growth_model(panel: DataFrame, keys: Sequence[str] = PANEL_KEYS) -> dict[str, DataFrame]:
    decomposition = growth.growth_decomposition(panel)
    return {
        "growth_decomposition": decomposition,
        "growth_top": growth.top_contributors(decomposition),
        "growth_metrics": metrics_long(growth.growth_metrics(panel)),
        "growth_figure": figures.top_movers(decomposition, keys),
    }


def concentration_model(
    panel: DataFrame, keys: Sequence[str] = PANEL_KEYS, labels: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Markets are the base level, the current level and positive growth."""
    rows = panels.drop_all_null(panel, ["value_base", "value_current"])
    measures = shares.indicator_measures(rows, keys)
    markets = shares.unpivot_markets(measures, keys, shares.INDICATOR_MARKETS)
    indices = concentration.concentration_indices(markets, ["market"], "capacity")
    return {
        "concentration_indices": concentration.label_markets(indices, labels or {}),
        "concentration_shares": shares.market_shares(markets, ["market"]),
        "concentration_top": shares.top_by_market(measures, keys, shares.INDICATOR_MARKETS),
        "concentration_run": run_metadata(rows, "concentration", MODEL_VERSION, "indicator", "panel_compare"),
    }


def actor_concentration_model(actors: DataFrame, base: int, current: int) -> dict[str, DataFrame]:
    """From (actor, period, total, armed, support): indices, shares and how they move."""
    rows = shares.unpivot_markets(
        panels.period_filter(actors, [base, current]), ["actor", "period"], shares.ACTOR_MARKETS
    )
    by = ["period", "market"]
    # Several tables below read the indices and the shares, whose ranks take the most work.
    indices = durable(concentration.concentration_indices(rows, by, "capacity", ties="row", variant="actor"))
    ranked = durable(shares.market_shares(rows, by, ties="min"))
    return {
        "actor_indices": concentration.hhi_trend(indices),
        "actor_shares": ranked,
        "actor_share_evolution": shares.share_evolution(ranked, base, current),
        "actor_mobility": shares.rank_mobility(ranked, base, current),
        "actor_dominance": shares.dominance(ranked, shares.ACTOR_MARKETS),
        "actor_barriers": concentration.entry_barriers(indices),
        "actor_hhi_range": concentration.hhi_range(indices),
    }


def composite_model(
    panel: DataFrame,
    keys: Sequence[str] = PANEL_KEYS,
    dimensions: Sequence[presets.Dimension] = presets.DIMENSIONS,
) -> dict[str, DataFrame]:
    table = durable(composite.composite_table(panel, dimensions))
    clusters = durable(composite.cluster_indicators(table, list(composite.COMPONENTS)))
    flags = {c.replace("is_", "share_", 1): c for c in table.columns if c.startswith("is_")}
    return {
        "composite_clusters": clusters,
        "composite_cluster_profiles": composite.cluster_profiles(
            clusters, {"avg_index": "composite", **flags, "avg_shock": "component_shock", "avg_growth": "growth_share",
                       "avg_stock": "stock_share"}),
        "composite_index": table,
        "composite_ranked": composite.ranked_index_table(table, keys),
        "composite_summary": composite.summary_by_type(table),
        "composite_diagnostics": composite.diagnostics(table),
        "composite_top": composite.top_dynamic(table, keys),
        "composite_metrics": metrics_long(composite.index_metrics(panel)),
        "composite_figure": figures.top_index(table, keys),
    }


def risk_model(
    panel: DataFrame,
    entity: Sequence[str] = (),
    indicators: Sequence[presets.RiskIndicator] = presets.RISK_INDICATORS,
    grid: dict[str, tuple[float, float, int]] | None = None,
) -> dict[str, DataFrame]:
    """One score per entity, or a single one without ``entity`` columns."""
    coded = risk.keep_known_codes(risk.map_codes(panel, indicators), indicators)
    components = durable(risk.score_components(coded, entity, indicators, labels=True))
    totals = risk.total_scores(components, entity, indicators)
    raw = risk.raw_scores(components, entity, indicators)
    varied = risk.weight_sensitivity(raw, entity, indicators, grid or presets.WEIGHT_GRID)
    one = list(entity) or ["all"]
    whole = components if entity else components.withColumn("all", F.lit(1))
    contribution = risk.score_contribution(whole, one)
    spread = risk.weight_sensitivity_stats(raw, entity, indicators, grid or presets.WEIGHT_GRID)
    return {
        "risk_run": run_metadata(components, "risk", MODEL_VERSION, "code", "panel_compare", {"indicators": len(indicators)}),
        "risk_components": components,
        "risk_contribution": contribution if entity else contribution.drop("all"),
        "risk_summary": risk.risk_summary(totals, "panel_compare", entity),
        "risk_sensitivity": varied,
        "risk_sensitivity_stats": spread,
        "risk_implications": risk.implications(components, entity, indicators),
        "risk_figure": figures.score_bars(components, entity),
    }


def scenario_model(
    base: DataFrame,
    keys: Sequence[str],
    base_col: str,
    scenario_list: Sequence[presets.Scenario] = presets.SCENARIOS,
    years: Sequence[int] = presets.PROJECTION_YEARS,
    base_year: int = presets.BASE_YEAR,
    thresholds: dict[str, float] | None = None,
) -> dict[str, DataFrame]:
    thresholds = thresholds or presets.THRESHOLDS
    projection = scenarios.project_scenarios(base, keys, base_col, scenario_list, years, base_year)
    return {
        "scenario_run": run_metadata(projection, "scenarios", MODEL_VERSION, "scenario_id", "panel_long", {
            "base_year": base_year, "projection_years": len(years), **{f"threshold_{n}": v for n, v in thresholds.items()}}),
        "scenario_projections": projection,
        "scenario_crossings": scenarios.threshold_crossings(projection, keys, thresholds),
        "scenario_comparison": scenarios.compare_to_baseline(projection, keys),
        "scenario_sensitivity": scenarios.rate_sensitivity(
            base, keys, base_col, years=years, base_year=base_year, thresholds=thresholds
        ),
    }


def run_models(
    raw: DataFrame,
    out_dir: str,
    base: int,
    current: int,
    base_match: dict[str, object],
    fmt: str = "parquet",
    default_capacity: float = presets.BASE_CAPACITY,
    raw_actors: DataFrame | None = None,
) -> list[str]:
    """Clean raw observations, run every model over one panel and write all tables.

    With raw actor counts the actor tables are written too.

    The long table and the panel are checkpointed once, since every model reads them, and the
    key of the long panel is checked before it is pivoted.
    """
    long = quality.assert_complete(durable(standardize_long(raw)), ["category", "indicator", "period"])
    repeated = quality.duplicate_keys(long, [*PANEL_KEYS, "period"]).head(1)
    if repeated:
        raise ValueError(f"the long panel has repeated keys, such as {repeated[0].asDict()}")
    panel = durable(panels.comparison_panel(long, base, current))
    capacity = panels.lookup_scalar(long, base_match, default=default_capacity)
    tables = {
        **panel_model(long, panel, [base, current]),
        **growth_model(panel),
        **concentration_model(panel),
        **composite_model(panel),
        **risk_model(panel),
        **scenario_model(capacity, [], "value"),
    }
    if raw_actors is not None:
        tables |= actor_concentration_model(durable(standardize_actor(raw_actors)), base, current)
    key_order = [F.col(c) for c in PANEL_KEYS]
    orders = {
        "growth_top": [F.col("contrib_growth").desc(), *key_order],
        "concentration_top": ["market", "rank", *key_order],
        "composite_ranked": [F.col("idx").desc(), *key_order],
        "composite_top": [F.col("idx").desc(), *key_order],
        "risk_components": [F.col("weighted_score").desc(), F.col("raw_score").desc(), "code"],
        "risk_contribution": [F.col("weighted_score").desc(), F.col("raw_score").desc(), "code"],
        "risk_figure": ["weighted_score", "code"],
        "risk_sensitivity": ["scenario_id"],
        "scenario_projections": ["scenario_id", "year"],
    }
    for name, table in tables.items():
        parts = ["period"] if name == "panel_long" else []
        write_table(table, f"{out_dir}/{name}", fmt, partition_by=parts, order_by=orders.get(name, []))
    return sorted(tables)
