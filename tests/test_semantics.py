"""Null, rounding, cast and tie rules."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright import presets
from panelwright.functions import (
    band, blank_to_null, clip_nonneg, delta_fraction, finite_or_null, normalize_key, safe_pct, signed_label, to_int,
    to_number, truncate_label,
)
from panelwright.operators import composite, concentration as con, growth, panel as panels, quality, risk, scenarios
from panelwright.operators import shares
from panelwright.presets import Scenario


def values(spark, kind, items, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_text_to_number(spark):
    texts = ["2025.7", "abc", "", "NA", " 12 ", "-3e2", "1d", "NaN", "9e999", "7.", ".5", None]
    assert values(spark, "string", texts, to_int) == [2025, None, None, None, 12, -300, None, None, None, 7, 0, None]
    assert values(spark, "string", texts[:6], to_number) == [2025.7, None, None, None, 12.0, -300.0]
    assert values(spark, "string", ["99999999999"], to_int) == [None]
    assert values(spark, "string", ["", " NA ", " x "], blank_to_null) == [None, None, "x"]


def test_normalize_key(spark):
    got = values(spark, "string", ["  Clan  del\tGolfo ", "ÁREA  X", None], normalize_key)
    assert got == ["clan del golfo", "área x", None]


def test_null_and_nonfinite_numbers(spark):
    odd = [None, float("nan"), float("inf"), float("-inf"), -2.0, 3.0]
    assert values(spark, "double", odd, finite_or_null) == [None, None, None, None, -2.0, 3.0]
    assert values(spark, "double", [None, -2.0, 3.0], clip_nonneg) == [None, 0.0, 3.0]


def test_changes(spark):
    rows = [(0, 0.0, 5.0), (1, None, 5.0), (2, -4.0, 2.0), (3, 4.0, 6.0), (4, 4.0, None)]
    df = spark.createDataFrame(rows, "i int, b double, c double")
    got = df.select("i", delta_fraction(F.col("b"), F.col("c")).alias("f"), safe_pct(F.col("b"), F.col("c")).alias("p"))
    assert [tuple(r)[1:] for r in got.orderBy("i").collect()] == [
        (None, None), (None, None), (-1.5, None), (0.5, 50.0), (None, None)
    ]


def test_signed_label(spark):
    numbers = [158.0, -26.0, 0.0, 1234567.0, 0.00001234, 0.5, 123456.7, 999999.9, None, float("nan"), 1e100]
    got = values(spark, "double", numbers, signed_label)
    assert got == [
        "NA" if x is None or math.isnan(x) else "%+g" % x for x in numbers
    ]


def test_truncate_label(spark):
    assert values(spark, "string", ["a" * 28, "b" * 29, None], truncate_label) == ["a" * 28, "b" * 25 + "...", None]


def test_bands(spark):
    scores = values(spark, "double", [19.9, 20.0, 50.0, 100.0, None], risk.band_score)
    assert scores == [0, 1, 2, 3, 0]
    moves = values(spark, "int", [-2, -1, 0, 1, 3, None],
                   lambda c: band(c, presets.MOBILITY_BANDS, presets.MOBILITY_REST))
    assert moves == ["Significant Decline", "Slight Decline", "Stable", "Slight Improvement",
                     "Significant Improvement", "Significant Decline"]
    assert values(spark, "double", [None, 999.0, 1000.0, 2500.0], con.hhi_category) == [
        None, "No concentrado", "Moderadamente concentrado", "Altamente concentrado"
    ]
    assert values(spark, "double", [0.26, 0.25, 0.1, 0.0, None], growth.growth_category) == [
        "Alto Crecimiento (>25%)", "Crecimiento Moderado (10-25%)", "Bajo Crecimiento (0-10%)",
        "Decrecimiento/NA", "Decrecimiento/NA"
    ]


def test_palma_of_small_groups(spark):
    df = spark.createDataFrame([("one", 4.0)] + [("same", 2.0)] * 18 + [("zero", 0.0)] * 3, "g string, x double")
    got = {r.g: r for r in con.concentration_indices(df, ["g"], "x").collect()}
    assert (got["one"].palma, got["one"].hhi, got["one"].effective_n, got["one"].gini) == (1.0, 10000.0, 1.0, 0.0)
    assert got["same"].palma == pytest.approx(1 / 8) and got["same"].gini == pytest.approx(0, abs=1e-12)
    assert (got["zero"].gini, got["zero"].hhi, got["zero"].palma, got["zero"].cr3) == (0.0, None, None, 0.0)


def test_dense_and_exact_ratios_differ_on_ties(spark):
    df = spark.createDataFrame([("g", x) for x in (9.0, 5.0, 2.0, 2.0, 2.0, 1.0)], "g string, x double")
    dense = con.concentration_ratios(df, ["g"], "x", (3,)).first().cr3
    exact = con.concentration_ratios(df, ["g"], "x", (3,), ties="row").first().cr3
    assert dense == pytest.approx(20 / 21 * 100) and exact == pytest.approx(16 / 21 * 100)


def test_rescale(spark):
    rows = [(1, 1.0, 5.0, None), (2, None, 5.0, None), (3, 3.0, None, None), (4, float("inf"), 5.0, None)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    got = composite.safe_rescale(df, {"ra": "a", "rb": "b", "rc": "c"}).orderBy("i").collect()
    assert [r.ra for r in got] == [0.0, None, 1.0, None]
    assert [r.rb for r in got] == [0.0] * 4 and [r.rc for r in got] == [0.0] * 4
    grouped = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 9.0)], "g string, x double")
    by = composite.safe_rescale(grouped, {"r": "x"}, by=["g"]).collect()
    assert sorted((r.g or "", r.r) for r in by) == [("", 0.0), ("", 1.0), ("a", 0.0)]


def test_base_only_rows(spark):
    df = spark.createDataFrame(
        [("c", "i", "u", 2024, 5.0), ("c", "j", "u", 2025, 6.0), ("c", "k", "u", 2024, None)],
        "category string, indicator string, unit string, period int, value double",
    )
    panel = panels.comparison_panel(df, 2024, 2025)
    assert panel.count() == 3
    assert panels.drop_all_null(panel, ["value_base", "value_current"]).count() == 2
    markets = shares.indicator_markets(panel, ["indicator"])
    assert {(r.indicator, r.market): r.capacity for r in markets.collect()}[("j", "stock_base")] == 0.0


def test_lookup(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 6.0), ("b", 1, None), ("c", 1, 7.0), ("d", 2, 8.0)],
                               "g string, p int, value double")
    got = {r.g: r.value for r in panels.lookup_scalar(df, {"p": 1}, default=-1.0, by=["g"]).collect()}
    assert got == {"a": -1.0, "b": -1.0, "c": 7.0, "d": -1.0}


def test_distinct_counts_null(spark):
    df = spark.createDataFrame([("c", None, 2024, 1.0, None), ("c", "i", None, None, 2.0)],
                               "category string, indicator string, period int, value double, reported_pct double")
    r = quality.coverage_scoreboard(df).first()
    assert (r.n_indicators, r.n_periods, r.share_value_na, r.share_reported_na) == (2, 2, 0.5, 0.5)


def test_snapshot_drift(spark):
    """The same rows as comparing all keys, with nulls, repeats and empty sides; equal buckets stay where they are."""
    kind = "a long, b string"
    old = spark.range(20000).selectExpr("id AS a", "if(id % 7 = 0, NULL, 'x') AS b")
    new = old.filter("a NOT IN (14, 15)").union(spark.createDataFrame([(None, "x"), (None, None), (99999, ""), (3, "x")], kind))
    sides = [(new, old), (old, old), (new.limit(0), old.limit(50)), (old.limit(0), old.limit(0))]
    for now, then in sides:
        want = sorted(map(repr, quality.contract_drift(now, then, ["a", "b"]).collect()))
        for buckets in (1, 500):
            assert sorted(map(repr, quality.snapshot_drift(now, then, ["a", "b"], buckets).collect())) == want
    # Six keys differ or repeat, so at most six buckets do, and rows of other buckets are not moved.
    assert 1 <= quality.differing_buckets(new, old, ["a", "b"], 500).count() <= 6
    assert quality.differing_buckets(old, old.orderBy("b"), ["a", "b"], 500).count() == 0
    plan = quality.snapshot_drift(old, old, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    with pytest.raises(ValueError, match="types"):
        quality.snapshot_drift(old, old.selectExpr("CAST(a AS int) AS a", "b"), ["a", "b"])


def test_drift_and_duplicates(spark):
    new = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    old = spark.createDataFrame([("b",), ("c",), (None,)], "k string")
    got = {(r.k, r.status) for r in quality.contract_drift(new, old, ["k"]).collect()}
    assert got == {("a", "added"), ("c", "removed")}
    assert quality.duplicate_keys(new.union(old), ["k"]).count() == 2


def test_rounding_is_half_even(spark):
    base = spark.createDataFrame([(5.0,), (7.0,)], "v double")
    flat = (Scenario(1, "half", -0.5),)
    got = scenarios.project_scenarios(base, [], "v", flat, years=[2026], base_year=2025).collect()
    assert sorted(r.capacity for r in got) == [2.0, 4.0]


def test_decelerating_projection(spark):
    base = spark.createDataFrame([(27121.0,)], "v double")
    slow = (Scenario(6, "slow", 0.235, kind="decelerating"),)
    rows = scenarios.project_scenarios(base, [], "v", slow).orderBy("year").collect()
    level, expected = 27121.0, []
    for i in range(5):
        level = round(level * (1 + 0.235 * 0.85**i))
        expected.append(level)
    assert [r.capacity for r in rows] == expected
    assert rows[1].effective_rate == pytest.approx(0.235 * 0.85)


def test_share_evolution_and_dominance(spark):
    rows = [("a", "m", 1, 0.5, 1), ("a", "m", 2, 0.5, 2), ("b", "m", 1, 0.4, 2), ("b", "m", 2, 0.6, 1),
            ("c", "m", 2, 0.1, 3), ("a", "n", 2, 0.3, 1), ("b", "n", 2, 0.2, 2)]
    df = spark.createDataFrame(rows, "actor string, market string, period int, share double, rank long")
    got = {(r.actor, r.market): r for r in shares.share_evolution(df, 1, 2).collect()}
    assert got[("a", "m")].change_direction == "Lost" and got[("b", "m")].change_direction == "Gained"
    assert got[("c", "m")].change_direction is None
    moved = {(r.actor, r.market): r.mobility for r in shares.rank_mobility(df, 1, 2).collect()}
    assert moved[("b", "m")] == "Slight Improvement" and moved[("c", "m")] == "Significant Decline"
    empty = shares.rank_mobility(df, 1, 3)
    assert empty.count() == 0 and "mobility" in empty.columns
    dominant = {(r.actor, r.market): r for r in shares.dominance(df, ["m", "n"], 0.40).collect()}
    assert dominant[("b", "m")].is_dominant and not dominant[("c", "m")].is_dominant
    assert dominant[("a", "n")].dominant_gap is None
    assert dominant[("a", "m")].dominant_gap == pytest.approx(0.1 / 0.6)


def test_entry_barriers(spark):
    df = spark.createDataFrame([("m", 1, 3000.0), ("m", 2, 2500.0), ("n", 2, 900.0)], "market string, period int, hhi double")
    got = {r.market: (r.barrier, r.barrier_implication) for r in con.entry_barriers(df).collect()}
    assert got == {"m": ("High", "Alto costo de entrada"), "n": ("Low", "Mercado abierto a competencia")}
    trend = {(r.market, r.period): r.hhi_trend for r in con.hhi_trend(df).collect()}
    assert trend == {("m", 1): None, ("m", 2): -500.0, ("n", 2): None}


def test_risk_of_entities_without_some_codes(spark):
    rows = [("e1", "Conflicto", "secuestro", 10.0, 20.0, 10.0), ("e2", "Conflicto", "dron x", None, None, None),
            ("e2", "Conflicto", "other", 1.0, 9.0, 8.0)]
    df = spark.createDataFrame(
        rows, "entity string, category string, indicator string, value_base double, value_current double, delta_abs double")
    coded = risk.keep_known_codes(risk.map_codes(df))
    components = risk.score_components(coded, ["entity"])
    got = {(r.entity, r.code): r for r in components.collect()}
    assert len(got) == 12
    assert got[("e1", "SEQ")].raw_score == 3 and got[("e1", "DRN")].value_base is None
    assert got[("e2", "DRN")].value_base == 0.0 and got[("e2", "DRN")].raw_score == 0
    totals = {r.entity: r for r in risk.total_scores(components, ["entity"]).collect()}
    assert totals["e1"].total_score == pytest.approx(3.6) and totals["e1"].risk_class == "BAJO (VERDE)"
    parts = [r.contribution_pct for r in risk.score_contribution(components, ["entity"]).filter("entity = 'e2'").collect()]
    assert parts == [0.0] * 6
    implied = {r.entity: r for r in risk.implications(components, ["entity"]).collect()}
    assert implied["e1"].critical_indicators is None


def test_contributions_sum_to_hundred(spark):
    df = spark.createDataFrame([("e", "A", 3.0), ("e", "B", 1.5)], "entity string, code string, weighted_score double")
    got = risk.score_contribution(df, ["entity"]).agg(F.sum("contribution_pct")).first()[0]
    assert got == pytest.approx(100)


def test_unpivot_is_inverse_of_pivot(spark, panel):
    keys = ["category", "indicator", "unit"]
    long = shares.unpivot_markets(panel, keys, ["value_base", "value_current"])
    wide = long.groupBy(*keys).pivot("market", ["value_base", "value_current"]).agg(F.max("capacity"))
    assert wide.exceptAll(panel.select(*wide.columns)).count() == 0


def test_clusters_and_profiles(spark):
    rows = [(i, float(i % 3) * 10, None if i % 5 == 0 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    labelled = composite.cluster_indicators(df, ["a", "b"], k=3)
    assert labelled.count() == 60 and {r.cluster for r in labelled.collect()} == {1, 2, 3}
    profiles = composite.cluster_profiles(df.withColumn("cluster", F.col("i") % 2), {"avg_a": "a", "avg_b": "b"})
    assert {r.n_indicators for r in profiles.collect()} == {30}
    assert all(r.avg_b == 1.0 for r in profiles.collect())


def plain_clusters(points, k, rounds=50):
    """Farthest-first seeds and Lloyd rounds over whole numbers, point by point."""
    def apart(p, q):
        return sum((a - b) ** 2 for a, b in zip(p, q))

    def digest(p):
        return hashlib.md5(",".join(map(str, p)).encode()).hexdigest()

    seeds = []
    while points and len(seeds) < k:
        best = min(points, key=lambda p: (-min([apart(p, s) for s in seeds], default=1), digest(p)))
        if best in seeds:
            break
        seeds.append(best)
    for _ in range(rounds):
        groups = {}
        for p in points:
            groups.setdefault(min(range(len(seeds)), key=lambda j: (apart(p, seeds[j]), j)), []).append(p)
        moved = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else s for j, s in enumerate(seeds)]
        if moved == seeds:
            break
        seeds = moved
    return [list(s) for s in seeds]


def test_clusters_match_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice([0.0, 0.0, draw.random(), None]), draw.random() ** 3) for i in range(300)] + [(1, 0.25, 0.5)] * 200
    df = spark.createDataFrame(rows, "i int, a double, b double")
    points = [(math.floor((a or 0) * 1e6 + 0.5), math.floor(b * 1e6 + 0.5)) for _, a, b in rows]
    for parts in (1, 7):
        assert composite.fit_clusters(df.repartition(parts), ["a", "b"], k=4) == plain_clusters(points, 4)
    few = spark.createDataFrame([(1, float("nan"), 1.0), (2, None, 1.0), (3, 1.0, None)], df.schema)
    assert len(composite.fit_clusters(few, ["a", "b"])) == 2
    assert sorted((r.i, r.cluster) for r in composite.cluster_indicators(few, ["a", "b"]).collect())[:2] in (
        [(1, 1), (2, 1)], [(1, 2), (2, 2)])
    assert composite.cluster_indicators(df.limit(0), ["a", "b"]).collect() == []


def test_rescale_by_group_has_the_same_rows_both_ways(spark):
    rows = [(i, None if i % 7 == 0 else "abc"[min(i % 9, 2)], None if i % 5 == 0 else float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:50], "i int, g string, x double").repartition(6)
    sent = composite.safe_rescale(df, {"r": "x"}, by=["g"])
    spread = composite.safe_rescale(df, {"r": "x"}, by=["g"], broadcast_groups=0)
    assert sorted(sent.collect(), key=str) == sorted(spread.collect(), key=str) and sent.count() == 450
    assert composite.safe_rescale(df.limit(0), {"r": "x"}, by=["g"], broadcast_groups=-1).collect() == []


@pytest.mark.parametrize("limit", [1 << 16, 0])
def test_sensitivity_by_vectors_equals_the_grid_per_entity(spark, monkeypatch, limit):
    monkeypatch.setattr(risk, "BROADCAST_VECTORS", limit)
    codes = [i.code for i in presets.RISK_INDICATORS]
    rows = [(None if e == 0 else e, *[None if (e + j) % 5 == 4 else (e * (j + 1)) % 4 for j in range(len(codes))])
            for e in range(40)]
    raw = spark.createDataFrame(rows, "entity int, " + ", ".join(f"raw_{c} int" for c in codes))
    want = risk.sensitivity_stats(risk.weight_sensitivity(raw, ["entity"]), ["entity"]).collect()
    got = risk.weight_sensitivity_stats(raw, ["entity"])
    assert got.columns == ["entity", "min_score", "max_score", "mean_score", "sd_score", "pct_red", "pct_amber", "pct_green"]
    got = {r.entity: r for r in got.collect()}
    assert len(got) == len(want) == 40
    for r in want:
        assert list(got[r.entity])[1:] == pytest.approx(list(r)[1:])
