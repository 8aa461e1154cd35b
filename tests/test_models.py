"""The runner from raw observations to written tables."""

import pytest
from pyspark.sql import functions as F

from panelwright.plans import models


def test_run_models(spark, tmp_path, long_df):
    headers = ["Categoría", "Indicador", "Año", "Valor", "Unidad", "Variación porcentual"]
    raw = long_df.toDF(*headers).withColumn("Año", F.col("Año").cast("string"))
    match = {"indicator": "Total_Integrantes", "period": 2025}
    actors = spark.createDataFrame(
        [(f" Grupo  {i}", str(p), str(10 * i + p % 7)) for i in range(1, 9) for p in (2024, 2025)] + [("", "2024", "5"), ("x", "no", "5")],
        "`Grupo Armado` string, `Año` string, `Número` string")
    names = models.run_models(raw, str(tmp_path), 2024, 2025, match, raw_actors=actors)
    read = {name: spark.read.parquet(str(tmp_path / name)) for name in names}
    counts = {
        "panel_long": 32, "panel_compare": 28, "panel_scoreboard": 5, "growth_decomposition": 18, "growth_top": 3,
        "concentration_indices": 3, "concentration_shares": 54, "concentration_top": 30, "composite_index": 28,
        "composite_summary": 4, "risk_components": 6, "risk_sensitivity": 125, "risk_implications": 1,
        "scenario_projections": 25, "scenario_comparison": 5, "scenario_sensitivity": 16,
        "composite_clusters": 28, "composite_cluster_profiles": 5, "actor_shares": 48, "actor_indices": 2,
        "actor_mobility": 24, "scenario_run": 1, "risk_run": 1,
    }
    assert {name: read[name].count() for name in counts} == counts
    assert read["risk_summary"].filter("metric = 'total_score'").first()["value"] == "9.1"
    assert read["concentration_run"].first().n_distinct == 18
    assert read["scenario_run"].first().n_distinct == 5 and read["risk_run"].first().indicators == 6
    shares = read["actor_shares"].filter("market = 'total' AND period = 2024")
    assert {r.actor for r in shares.collect()} == {f"grupo {i}" for i in range(1, 9)}
    assert sum(r.share for r in shares.collect()) == pytest.approx(1)
    assert read["composite_cluster_profiles"].agg(F.sum("n_indicators")).first()[0] == 28


def test_repeated_keys_stop_the_run(spark, tmp_path, long_df):
    raw = long_df.union(long_df.limit(1)).withColumnsRenamed({
        "category": "categoria", "indicator": "indicador", "period": "year", "reported_pct": "pct"
    })
    with pytest.raises(ValueError, match="repeated keys"):
        models.run_models(raw, str(tmp_path), 2024, 2025, {"indicator": "x"})


def test_actor_model(spark):
    rows = [(f"a{i}", p, float(10 * i + p % 7), float(i)) for i in range(1, 9) for p in (2024, 2025)]
    actors = spark.createDataFrame(rows, "actor string, period int, total double, armed double")
    actors = actors.withColumn("support", F.col("total") - F.col("armed"))
    tables = models.actor_concentration_model(actors, 2024, 2025)
    assert tables["actor_indices"].count() == 6 and tables["actor_shares"].count() == 48
    assert tables["actor_mobility"].filter("mobility = 'Stable'").count() > 0
    assert tables["actor_barriers"].count() == 3 and tables["actor_dominance"].count() == 24
    total = tables["actor_shares"].groupBy("period", "market").agg(F.sum("share").alias("s"))
    assert all(r.s == pytest.approx(1) for r in total.collect())
