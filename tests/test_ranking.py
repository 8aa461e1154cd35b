"""Ranks and indices against brute force, on skewed and crowded data."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from panelwright.operators import concentration as con, ranking, shares


def frame(spark, groups, partitions=7):
    rows = [(g, f"{g}-{i:05d}", x) for g, values in groups.items() for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "g string, k string, x double").repartition(partitions)


def clean(values):
    return [max(x, 0.0) for x in values if x is not None and math.isfinite(x)]


def brute(values):
    x = sorted(clean(values))
    n, s = len(x), sum(x)
    if n == 0:
        return None
    down = x[::-1]
    gini = 0.0 if s <= 0 else 2 * sum((i + 1) * v for i, v in enumerate(x)) / (n * s) - (n + 1) / n
    bottom = sum(down[math.ceil(n * 0.6) - 1:])
    palma = sum(down[:max(1, math.floor(n * 0.1))]) / bottom if s > 0 and bottom > 0 else None
    hhi = sum((v / s) ** 2 for v in x) * 10000 if s > 0 else None
    third = sorted(set(x), reverse=True)[:3]
    return {
        "n": n, "total": s, "gini": gini, "palma": palma, "hhi": hhi,
        "cr3": sum(v for v in x if v in third) / s * 100 if s > 0 else 0.0,
        "row3": sum(down[:3]) / s * 100 if s > 0 else None,
    }


def same(a, b):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def check_indices(spark, groups, partitions=7):
    df = frame(spark, groups, partitions)
    dense = {r.g: r for r in con.concentration_indices(df, ["g"], "x").collect()}
    exact = {r.g: r for r in con.concentration_ratios(df, ["g"], "x", ks=(3,), ties="row").collect()}
    expected = {g: brute(values) for g, values in groups.items()}
    assert set(dense) == {g for g, b in expected.items() if b}
    for g, r in dense.items():
        for name in ("n", "total", "gini", "palma", "hhi", "cr3"):
            assert same(getattr(r, name), expected[g][name]), (g, name, getattr(r, name), expected[g][name])
        assert same(exact[g].cr3, expected[g]["row3"])


def skewed(rng):
    return {
        "a third zeros": [0.0] * 300 + [rng.lognormvariate(3, 2) for _ in range(600)],
        "one hot value": [5.0] * 500 + [float(rng.randint(1, 20)) for _ in range(300)],
        "close together": [1000 + rng.random() * 1e-6 for _ in range(400)] + [1e9, 0.0],
        "wide": [10.0 ** rng.uniform(-200, 200) for _ in range(300)],
        "bad": [None, float("nan"), float("inf"), -3.0, 2.0, 4.0],
        "zeros": [0.0] * 12, "single": [7.0], "equal": [3.0] * 18, "none": [None, float("nan")],
    }


def test_indices_match_brute_force(spark):
    check_indices(spark, skewed(random.Random(1)))


@pytest.mark.parametrize("partitions, ranges", [(1, 1), (17, 40)])
def test_any_number_of_ranges(spark, partitions, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        check_indices(spark, skewed(random.Random(2)), partitions)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(0, 1e12, allow_subnormal=True), min_size=1, max_size=60))
def test_invariants(spark, values):
    r = con.concentration_indices(frame(spark, {"g": values}, 3), ["g"], "x").first()
    assert -1e-9 <= r.gini < 1 and r.cr3 <= r.cr5 + 1e-9
    if r.hhi is not None:
        assert 1e4 / r.n - 1e-6 <= r.hhi <= 1e4 + 1e-6
    check_indices(spark, {"g": values}, 3)


def test_equal_rows_are_spread(spark):
    """One value holds nearly all rows: its rows lie in many ranges and are ranked as one value."""
    x = F.when(F.col("id") % 400 == 0, F.col("id")).otherwise(7).cast("double")
    rows = spark.range(0, 40000, 1, 8).select(F.lit("g").alias("g"), x.alias("x"), "id")
    ranked = ranking.attach_ranks(rows, ["g"], "x").withColumn("task", F.spark_partition_id())
    found = ranked.filter("x = 7").agg(
        F.count(F.lit(1)), F.countDistinct("task"), F.min("ranks.above_rows"), F.max("ranks.above_rows"),
        F.min("ranks.above_values"), F.max("ranks.above_values"), F.countDistinct("ranks.running_mass")).first()
    above = sum(i > 7 for i in range(0, 40000, 400))
    assert tuple(found) == (39900, int(spark.conf.get("spark.sql.shuffle.partitions")), above, above, above, above, 39900)


def test_equal_values_collapse_before_the_shuffle(spark):
    """A million equal values at the cut of the top tenth and of the top three."""
    x = F.when(F.col("id") < 100, F.col("id") + 10).when(F.col("id") % 4 == 0, 1).otherwise(5).cast("double")
    rows = spark.range(0, 1_400_000, 1, 8).select(F.lit("g").alias("g"), x.alias("x"))
    counts = ranking.value_counts(rows, ranking.Grouping(rows, ["g"]), "x")
    assert counts.count() < 2000
    values = [float(i + 10) for i in range(100)] + [1.0 if i % 4 == 0 else 5.0 for i in range(100, 1_400_000)]
    expected = brute(values)
    assert same(con.palma(rows, ["g"], "x").first().palma, expected["palma"])
    assert same(con.gini(rows, ["g"], "x").first().gini, expected["gini"])
    top = con.concentration_ratios(rows.filter("x <= 5"), ["g"], "x", ks=(1, 2)).first()
    fives = sum(v == 5 for v in values)
    assert same(top.cr1, 100 * 5 * fives / (5 * fives + sum(v == 1 for v in values))) and same(top.cr2, 100)
    share = con.top_share(rows, "x", [0.5]).first().top50
    down = sorted(values, reverse=True)
    assert same(share, sum(down[:700_000]) / sum(values))


def test_rows_are_shuffled_once(spark):
    def dealt(built):
        built.collect()
        plan = built._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "SortMergeJoin" not in plan
        return plan.count("Exchange rangepartitioning")

    df = spark.range(0, 1000, 1, 4).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"), "id")
    assert dealt(con.gini(df, ["g"], "x")) == 1
    # Here ranges were dealt when the plan was built, and written.
    assert dealt(shares.cumulative_shares(df, ["g"], "x", ["id"])) == 0 == dealt(shares.market_shares(df, ["g"], "x"))
    plan = con.concentration_ratios(df, ["g"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "WindowGroupLimit" in plan


def test_columns_that_are_constant(spark):
    """A constant column is folded into plans; ranks do not depend on it."""
    rows = spark.range(0, 3000, 1, 8).select(
        F.lit("g").alias("g"), F.lit("c").alias("unit"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).cast("double").alias("x"), "id")
    ranked = shares.market_shares(rows, ["g"], "x").drop("unit").filter("x = 0").select("rank").distinct().collect()
    assert [r["rank"] for r in ranked] == [1000]


def test_bucket_totals(spark):
    df = frame(spark, skewed(random.Random(4)))
    for ties in ("dense", "min"):
        want = {(r.g, r.bucket): (r["count"], r["sum(x)"]) for r in shares.market_shares(
            df.filter("x >= 0 AND x < 1e300"), ["g"], "x", ties).groupBy("g", "bucket").agg(
                F.count(F.lit(1)).alias("count"), F.sum("x")).collect()}
        got = {(r.g, r.bucket): (r.n, r.x) for r in shares.bucket_totals(
            df.filter("x >= 0 AND x < 1e300"), ["g"], "x", ties).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and same(got[k][1], want[k][1]) for k in want)


def test_gini_of_very_large_groups(spark):
    """Counts of 10^11 rows, as a histogram would have them: half of the rows 1, half 3."""
    half = 10**11
    rows = [(1.0, half, 2 * half, 4.0 * half, half, 3.0 * half, 1), (3.0, half, 2 * half, 4.0 * half, 0, 0.0, 0)]
    ranks = spark.createDataFrame(
        rows, "x double, rows bigint, group_rows bigint, group_mass double, above_rows bigint, above_mass double, above_values bigint")
    assert same(ranks.agg(con._gini().alias("gini")).first().gini, 0.25)


def test_ranks_of_rows(spark):
    groups = skewed(random.Random(3))
    df = frame(spark, groups)
    dense = {r.k: r for r in shares.market_shares(df, ["g"], "x").collect()}
    least = {r.k: r for r in shares.market_shares(df, ["g"], "x", ties="min").collect()}
    assert len(dense) == sum(map(len, groups.values()))
    for g, values in groups.items():
        kept = clean(values)
        order = sorted(set(kept), reverse=True)
        total = sum(kept)
        for i, x in enumerate(values):
            r, m = dense[f"{g}-{i:05d}"], least[f"{g}-{i:05d}"]
            if x is None or not math.isfinite(x):
                assert r.rank is None and r.share is None
                continue
            x = max(x, 0.0)
            assert r.rank == order.index(x) + 1
            assert m.rank == sum(v > x for v in kept) + 1
            assert same(r.share, x / total if total > 0 else 0.0)


def test_cumulative_shares(spark):
    groups = {"hot": [5.0] * 40 + [1.0, 9.0, 2.0], "zero": [0.0] * 3}
    got = {r.k: r.cum_share for r in shares.cumulative_shares(frame(spark, groups), ["g"], "x", ["k"]).collect()}
    for g, values in groups.items():
        keys = [f"{g}-{i:05d}" for i in range(len(values))]
        order = sorted(range(len(values)), key=lambda i: (-values[i], hashlib.md5(keys[i].encode()).hexdigest()))
        total, running = sum(values), 0.0
        for i in order:
            running += values[i]
            assert same(got[keys[i]], running / total if total else 0.0)


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, x double")
    got = {r.g: r for r in con.concentration_indices(df, ["g"], "x").collect()}
    assert got[None].n == 2 and same(got[None].hhi, 6250)
    ranked = {(r.g, r.x): r["rank"] for r in shares.market_shares(df, ["g"], "x").collect()}
    assert ranked == {(None, 1.0): 2, (None, 3.0): 1, ("a", 2.0): 1}


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert con.concentration_indices(df, ["g"], "x").count() == 0
    assert con.gini(df, [], "x").first() is None
    assert shares.market_shares(df, ["g"], "x").count() == 0


def test_top_share(spark):
    values = [10.0, 1.0, 5.0, 5.0, 2.0, None, None, 0.0]
    got = con.top_share(frame(spark, {"g": values}), "x", [0.2, 0.5]).first()
    assert same(got.top20, 15 / 23) and same(got.top50, 22 / 23)
