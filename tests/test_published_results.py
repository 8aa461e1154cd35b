"""Published results on the small indicator table."""

import math

import pytest
from pyspark.sql import functions as F

from panelwright import presets
from panelwright.operators import composite, concentration, figures, growth, metrics, panel as panels, quality
from panelwright.operators import risk, scenarios, shares
from panelwright.operators.panel import PANEL_KEYS


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_comparison_panel(panel):
    rows = rows_by(panel, "indicator")
    assert len(rows) == 28
    assert sum(r.delta_abs is not None for r in rows.values()) == 4
    drones = rows[("Ataques_con_Drones",)]
    assert (drones.value_base, drones.value_current, drones.delta_abs) == (119, 277, 158)
    assert close(drones.delta_frac, 1.3277310924369747)
    assert rows[("Zonas_en_Disputa",)].delta_frac is None


def test_scoreboard(long_df):
    rows = rows_by(quality.coverage_scoreboard(long_df), "category")
    expected = {
        "Grupos_Armados": (7, 7, 1, 0, 0.5714285714285714),
        "Seguridad_Ciudadana": (7, 8, 2, 0.625, 0.125),
        "Conflicto": (6, 8, 2, 0.25, 0.5),
        "Impacto_Humanitario": (6, 7, 2, 0.2857142857142857, 0.5714285714285714),
        "Estado": (2, 2, 1, 0.5, 0.5),
    }
    assert len(rows) == 5
    for name, values in expected.items():
        assert all(close(a, b) for a, b in zip(tuple(rows[(name,)])[1:], values))


def test_contract_dictionary_profile(long_df):
    contract = rows_by(quality.indicator_contract(long_df, [2024, 2025]), "indicator")
    assert len(contract) == 28
    drones = contract[("Ataques_con_Drones",)]
    assert (drones.n_rows, drones.periods, drones.has_2024, drones.has_2025) == (2, "2024;2025", True, True)
    assert (drones.share_value_na, drones.share_reported_na) == (0.0, 0.5)
    assert not contract[("Zonas_en_Disputa",)].has_2024
    assert quality.indicator_dictionary(long_df).count() == 28
    profile = rows_by(metrics.metrics_long(quality.ingest_profile(long_df, "Total_Integrantes", 2025)), "metric")
    got = {k[0]: r.value for k, r in profile.items()}
    assert got == {"rows": 32, "cols": 6, "n_categories": 5, "n_indicators": 28, "checksum": 27121}
    assert quality.duplicate_keys(long_df, [*PANEL_KEYS, "period"]).count() == 0


def base_capacity(long_df):
    match = {"indicator": "Total_Integrantes", "period": 2025}
    return panels.lookup_scalar(long_df, match, default=presets.BASE_CAPACITY)


def test_scenario_projection(long_df):
    rows = rows_by(scenarios.project_scenarios(base_capacity(long_df), [], "value"), "scenario_id", "year")
    expected = {
        1: [33494, 41366, 51087, 63092, 77918],
        2: [29833, 32816, 36098, 39708, 43679],
        3: [27121] * 5,
        4: [25765, 24477, 23253, 22090, 20986],
        5: [29052, 30587, 31770, 32660, 33318],
    }
    got = {s: [rows[(s, y)].capacity for y in range(2026, 2031)] for s in expected}
    assert got == expected
    assert rows[(5, 2026)].effective_rate is None and rows[(5, 2026)].scenario_rate is None
    assert rows[(4, 2026)].effective_rate == -0.05


def test_threshold_crossings(long_df):
    projection = scenarios.project_scenarios(base_capacity(long_df), [], "value")
    rows = rows_by(scenarios.threshold_crossings(projection, []), "scenario_id")
    expected = {
        1: (2027, 2026, 2026, 187.29766601526495, 23.5, 77918),
        2: (2030, 2027, 2026, 61.05232107960621, 10, 43679),
        3: (None, None, 2026, 0, 0, 27121),
        4: (None, None, 2026, -22.620847313889602, -5, 20986),
        5: (None, 2027, 2026, 22.849452453818063, None, 33318),
    }
    for key, values in expected.items():
        assert all(close(a, b) for a, b in zip(tuple(rows[(key,)])[2:], values))


def test_scenario_comparison_and_sensitivity(long_df):
    projection = scenarios.project_scenarios(base_capacity(long_df), [], "value")
    rows = rows_by(scenarios.compare_to_baseline(projection, []), "scenario_name")
    assert close(rows[("Contención Parcial",)].pct_vs_baseline, -43.942349649631666)
    assert rows[("Saturación",)].diff_vs_baseline == -44600
    rates = scenarios.rate_sensitivity(base_capacity(long_df), [], "value").orderBy("base_rate").collect()
    assert [r.final_capacity for r in rates] == [
        54550, 56963, 59461, 62046, 64720, 67486, 70345, 73300, 76354, 79509, 82767, 86131, 89603, 93187, 96884, 100698
    ]
    assert rates[2].base_rate == 0.16999999999999998
    assert all(r.over_crisis and r.over_high_risk for r in rates)


def test_growth(panel):
    rows = rows_by(growth.growth_decomposition(panel), "indicator")
    assert len(rows) == 18
    kidnap = rows[("Secuestro",)]
    assert close(kidnap.contrib_growth, 0.6654740608228981) and close(kidnap.contrib_stock, 3.207046635187361e-4)
    assert (kidnap.growth_category, kidnap.contrib_category) == ("Alto Crecimiento (>25%)", "Motor Principal (>20%)")
    leaders = rows[("Homicidios_Lideres_Sociales",)]
    assert (leaders.delta_pos, leaders.contrib_growth, leaders.contrib_category) == (0, 0, "Sin crecimiento")
    assert rows[("Zonas_en_Disputa",)].delta_pos is None
    assert rows[("Enfrentamientos_entre_Grupos",)].contrib_category == "Contribuyente Medio (5-10%)"
    assert growth.top_contributors(growth.growth_decomposition(panel)).count() == 3
    m = growth.growth_metrics(panel).first()
    assert close(m.gini_growth_pos, 0.5567978533094813)
    assert tuple(m)[1:] == (1, 1, 559, 533, 18)


def test_concentration_indices(panel):
    rows = panels.drop_all_null(panel, ["value_base", "value_current"])
    markets = shares.indicator_markets(rows, PANEL_KEYS)
    got = rows_by(concentration.concentration_indices(markets, ["market"], "capacity"), "market")
    expected = {
        "growth_pos": (559, 5254.3674655419045, 1.903178653868408, 100, 100, 0.9015106340687735, None),
        "stock_base": (652, 3002.135947909218, 3.330961746407359, 86.80981595092025, 100, 0.8312883435582823, None),
        "stock_current": (2029905, 4250.4244730445225, 2.352706197561754, 96.21957677822361, 98.23518834625267,
                          0.8678732639102706, 1213.592233009709),
    }
    for market, values in expected.items():
        r = got[(market,)]
        assert r.n == 18
        assert all(close(a, b) for a, b in
                   zip((r.total, r.hhi, r.effective_n, r.cr3, r.cr5, r.gini, r.palma), values))
        assert r.hhi_category == "Altamente concentrado"


def test_share_details(panel):
    rows = panels.drop_all_null(panel, ["value_base", "value_current"])
    got = rows_by(shares.market_shares(shares.indicator_markets(rows, PANEL_KEYS), ["market"]), "market", "indicator")
    assert len(got) == 54
    r = got[("stock_current", "Ataques_Drones_EMC")]
    assert (r.capacity, r.total_market, r.rank, r.bucket) == (237, 2029905, 12, "Others")
    assert close(r.share, 1.1675423234092235e-4)
    assert (got[("stock_base", "Zonas_en_Disputa")].rank, got[("stock_base", "Zonas_en_Disputa")].bucket) == (5, "Top 5")
    assert got[("growth_pos", "Secuestro")].bucket == "Leader"
    top = shares.top_by_market(shares.indicator_measures(rows, PANEL_KEYS), PANEL_KEYS, shares.INDICATOR_MARKETS)
    top = top.orderBy("market", "rank", "category", "indicator").collect()
    assert len(top) == 30
    assert [r.indicator for r in top[:5]] == [
        "Secuestro", "Ataques_con_Drones", "Enfrentamientos_entre_Grupos", "Ataques_Drones_EMC", "Zonas_en_Disputa"
    ]
    assert [r.rank for r in top[20:]] == list(range(1, 11))


def test_composite(panel):
    table = composite.composite_table(panel)
    rows = rows_by(table, "indicator")
    drones = rows[("Ataques_con_Drones",)]
    assert close(drones.composite, 0.22389210019267822) and drones.typology == "Innovación táctica"
    assert close(drones.component_shock, 0.3815028901734104)
    assert close(rows[("Enfrentamientos_entre_Grupos",)].composite, 0.2013005780346821)
    assert close(rows[("Secuestro",)].composite, 0.1501488) and rows[("Secuestro",)].typology == "Mixto"
    assert close(rows[("Afectados_Confinamiento",)].composite, 0.05)
    assert close(rows[("Homicidios_Lideres_Sociales",)].composite, 1.04e-05)
    assert rows[("Amenazas_Variacion",)].composite == 0 and rows[("Amenazas_Variacion",)].component_control is None
    summary = rows_by(composite.summary_by_type(table), "typology")
    expected = {
        "Mixto": (23, 168110, 346, 372, 0.006892393478260869),
        "Innovación táctica": (2, 514, 158, 158, 0.11195197509633911),
        "Competencia/Disputa": (1, 115, 29, 29, 0.2013005780346821),
        "Dominante por nivel (stock)": (2, 1861166, 0, 0, 0.046529150000000005),
    }
    for name, values in expected.items():
        assert all(close(a, b) for a, b in zip(tuple(summary[(name,)])[2:], values))
        assert summary[(name,)].priority == "Baja Prioridad"
    assert tuple(composite.diagnostics(table).first()) == (28, 0, 24, 24, 10, 533, 559)
    top = composite.top_dynamic(table, ["category", "indicator"]).collect()
    assert [r.idx for r in sorted(top, key=lambda r: -r.idx)] == [0.224, 0.201, 0.15, 0.0]


def test_index_metrics(panel):
    m = composite.index_metrics(panel).first()
    expected = (28, 3, 559, 533, 0.5567978533094813, 0.8678732639102706, 5254.3674655419045, 4250.4244730445225)
    assert all(close(a, b) for a, b in zip(m, expected))


def test_legacy_index(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.0, 0.0, 1.0, 1.0, 6.48001944005832e-4), ("b", 0.0, 1.0, 0.0, None, 0.4, 0.1)],
        "name string, social double, tech double, dispute double, shock double, growth_share double, stock_share double",
    )
    rows = rows_by(composite.weighted_sum(df, presets.LEGACY_WEIGHTS, "idx"), "name")
    assert close(rows[("a",)].idx, 0.5500324000972003)
    assert rows[("b",)].idx is None


def coded(panel):
    return risk.keep_known_codes(risk.map_codes(panel))


def test_risk_components(panel):
    components = risk.score_components(coded(panel), [], labels=True)
    rows = rows_by(components, "code")
    expected = {
        "DRN": (119, 514, 331.9327731092437, 3, 4.5),
        "SEQ": (279, 651, 133.33333333333331, 3, 3.5999999999999996),
        "ENF": (86, 115, 33.72093023255814, 1, 1),
        "DES": (0, 92000, None, 0, 0),
        "HLS": (168, 142, -15.476190476190476, 0, 0),
        "ATC": (0, 0, None, 0, 0),
    }
    for code, values in expected.items():
        r = rows[(code,)]
        got = (r.value_base, r.value_current, r.pct_change, r.raw_score, r.weighted_score)
        assert all(close(a, b) for a, b in zip(got, values))
    assert (rows[("DRN",)].category, rows[("DRN",)].indicator) == ("Conflicto", "Ataques_Drones_EMC")
    assert rows[("HLS",)].adjusted_change > 0
    collapsed = rows_by(risk.collapse_codes(coded(panel), []), "code")
    assert collapsed[("DRN",)].delta_abs == 158 and collapsed[("DES",)].delta_abs == 92000


def test_risk_totals(panel):
    components = risk.score_components(coded(panel), [])
    total = risk.total_scores(components, []).first()
    assert close(total.total_score, 9.1) and total.risk_class == "ALTO (ROJO)" and close(total.max_possible, 19.2)
    parts = rows_by(risk.score_contribution(components.withColumn("e", F.lit(1)), ["e"]), "code")
    assert close(parts[("DRN",)].contribution_pct, 4.5 / 9.1 * 100)
    assert close(parts[("SEQ",)].contribution_pct, 3.6 / 9.1 * 100)
    assert close(parts[("ENF",)].contribution_pct, 1 / 9.1 * 100)
    implied = risk.implications(components, []).first()
    assert implied.critical_indicators == "Ataques con drones; Secuestros"
    assert implied.immediate_actions.startswith("Activar protocolo")
    long = rows_by(risk.risk_summary(risk.total_scores(components, []), "panel"), "metric")
    assert {k[0]: r.value for k, r in long.items()} == {
        "total_score": "9.1", "risk_classification": "ALTO (ROJO)", "max_possible": "19.2", "input_panel": "panel"
    }


def test_risk_sensitivity(panel):
    raw = risk.raw_scores(risk.score_components(coded(panel), []), [])
    grid = risk.weight_sensitivity(raw, [])
    rows = rows_by(grid, "scenario_id")
    assert len(rows) == 125
    assert close(rows[(1,)].total_score, 7.7) and close(rows[(4,)].total_score, 8.6)
    assert close(rows[(10,)].weight_SEQ, 1.4) and close(rows[(10,)].weight_DRN, 1.4)
    s = risk.sensitivity_stats(grid, []).first()
    assert all(close(a, b) for a, b in zip((s.min_score, s.max_score, s.mean_score), (7.7, 10.5, 9.1)))
    assert s.sd_score == pytest.approx(0.6189221, abs=1e-7)
    assert (s.pct_red, s.pct_amber, s.pct_green) == (100, 0, 0)


def test_figure_tables(panel):
    movers = figures.top_movers(growth.growth_decomposition(panel), ["category", "indicator"]).collect()
    labels = {r.indicator: r.label for r in movers}
    assert len(movers) == 12
    assert labels["Ataques_con_Drones"] == "+158" and labels["Homicidios_Lideres_Sociales"] == "-26"
    assert labels["Ataques_Drones_EMC"] == "NA"
    top = figures.top_index(composite.composite_table(panel), ["category", "indicator"]).collect()
    assert len(top) == 12 and max(top, key=lambda r: r.composite).indicator == "Ataques_con_Drones"
    bars = rows_by(figures.score_bars(risk.score_components(coded(panel), [])), "code")
    assert bars[("ENF",)].label == "Enfrentamientos entre grupos"
    long_name = figures.score_bars(risk.score_components(coded(panel), []), width=20)
    assert rows_by(long_name, "code")[("ENF",)].label == "Enfrentamientos e..."
