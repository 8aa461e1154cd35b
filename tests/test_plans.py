"""Physical plans of the registered queries, and the queries against their SQL."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from panelwright.operators import panel as panels
from panelwright.sources import write_table

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.QUERIES, entry_module.ORACLES
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")
# Clusters are fitted by jobs of their own, so that query has no single plan.
PLANNED = sorted(set(QUERIES) - {"idx15_cluster_indicators"})


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", PLANNED)
def test_plan_has_no_hazards(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "EvalPython" not in plan and "InPandas" not in plan
    for line in plan.splitlines():
        window = re.search(r"Window \[.*\], \[(.*?)\](, \[.*\])?$", line.strip())
        if window:
            assert window.group(1), line


def columns_read(plan):
    return set(re.findall(r"ReadSchema: struct<(.*?)>", plan))


@needs_data
def test_scans_read_and_filter_little(spark):
    plan = physical(QUERIES["con06_hhi"](spark, SMALL))
    assert any("o_custkey" in c and "o_orderpriority" not in c for c in columns_read(plan))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan)


@needs_data
@pytest.mark.parametrize("name", ["pnl02_pivot_compare", "cln13_period_filter"])
def test_two_periods_are_a_date_range_in_the_scan(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)


@needs_data
def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in physical(QUERIES["con12_top_k_per_group"](spark, SMALL))
    assert "TakeOrderedAndProject" in physical(QUERIES["idx13_top_dynamic"](spark, SMALL))


@needs_data
def test_scenarios_add_no_shuffle(spark):
    """The grouping by entity of the base table serves the grouping by entity and scenario."""
    one = physical(QUERIES["scn01_project_exponential"](spark, SMALL)).count("Exchange hashpartitioning")
    assert physical(QUERIES["scn05_threshold_crossings"](spark, SMALL)).count("Exchange hashpartitioning") == one
    one = physical(QUERIES["rsk11_score_components"](spark, SMALL)).count("Exchange hashpartitioning")
    assert physical(QUERIES["rsk13_weight_sensitivity"](spark, SMALL)).count("Exchange hashpartitioning") == one


@needs_data
def test_weight_grid_is_expanded_over_vectors_only(spark):
    """The grid lies above the distinct vectors, inside the broadcast side; entities are not exchanged for the join."""
    plan = physical(QUERIES["rsk14_sensitivity_stats"](spark, SMALL))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    entities, vectors = plan.split("BroadcastExchange", 1)
    assert "posexplode" not in entities and vectors.count("posexplode") == 3


@needs_data
def test_ranges_of_few_groups_do_not_move_the_rows(spark):
    plan = physical(QUERIES["idx06_safe_rescale_by_group"](spark, SMALL))
    assert "BroadcastHashJoin" in plan and "range_key" not in "".join(re.findall(r"Exchange hashpartitioning\(.*", plan))


@needs_data
def test_ranks_scan_the_source_once(spark):
    df = QUERIES["con04_gini_prices"](spark, SMALL)
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("Exchange rangepartitioning") == 1


@needs_data
def test_oracles_cover_the_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@needs_data
def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 3 and "hhi" in df.columns


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    return repr(float(value) + 0.0)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(v) for v in row) for row in result.fetchall())
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*names).collect())
    assert got == want


def test_the_last_period_of_a_partitioned_table_is_one_folder(spark, tmp_path):
    """The period is known only at run time; folders of other periods are not opened."""
    path = str(tmp_path / "facts")
    rows = spark.range(400).selectExpr("id", "CAST(2020 + id % 4 AS int) AS period")
    write_table(rows, path, partition_by=["period"])
    facts = spark.read.schema(rows.schema).parquet(path)
    for old in (tmp_path / "facts" / "period=2021").glob("*.parquet"):
        old.write_bytes(b"not a table")
    for crc in (tmp_path / "facts" / "period=2021").glob(".*.crc"):
        crc.unlink()
    periods = spark.createDataFrame([(2020,), (2021,), (2022,), (2023,)], "period int")
    last = panels.latest_period(facts, seen_in=periods)
    assert re.search(r"PartitionFilters: \[[^\]]*[Ss]ubquery", physical(last))
    assert last.count() == 100
    with pytest.raises(Exception):
        facts.agg({"id": "max"}).collect()
