"""Files, column names and guards."""

import contextlib
import random

import pytest
from pyspark.sql import types as T

from panelwright.operators import panel as panels, quality
from panelwright.presets import ACTOR_ALIASES
from panelwright.sources import (
    LONG_SCHEMA, ColumnsMissing, clean_names, durable, read_indicator_csv, read_with_quarantine, resolve_columns,
    standardize_long, validate_schema, write_table,
)

SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.DoubleType()),
                       T.StructField("note", T.StringType())])


def test_csv_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n,note\nNA,NA,\n"",1.5,"a, ""b"""\n x ,,NA\n')
    rows = read_indicator_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()
    assert [tuple(r) for r in rows] == [(None, None, None), (None, 1.5, 'a, "b"'), ("x", None, None)]


def test_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n,note\nok,1,"a, b"\nlong,2,a, b\nshort,3\nbad,abc,x\nlast,NA,y\n')
    (tmp_path / "b.csv").write_text("name,n,note\nsecond,5,z\n")
    good, bad = read_with_quarantine(spark, str(tmp_path), SCHEMA)
    assert sorted(tuple(r) for r in good.collect()) == [("last", None, "y"), ("ok", 1.0, "a, b"), ("second", 5.0, "z")]
    assert sorted(r.corrupt_line for r in bad.collect()) == ["bad,abc,x", "long,2,a, b", "short,3"]
    assert good.count() == 3 and bad.count() == 3


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('note,extra,name,n\n"two\nlines, ""q"" \x01",9,x, 1.5\n')
    rows = read_indicator_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()
    assert [tuple(r) for r in rows] == [("x", 1.5, 'two\nlines, "q" \x01')]
    (tmp_path / "b.csv").write_text("name,note\nx,y\n")
    with pytest.raises(ColumnsMissing, match="n among"):
        read_indicator_csv(spark, str(tmp_path / "b.csv"), SCHEMA)


@pytest.mark.parametrize("line", ["a,1,x,EXTRA", "a,abc,x", "a,1"])
def test_csv_loses_nothing_silently(spark, tmp_path, line):
    (tmp_path / "a.csv").write_text(f"name,n,note\n{line}\n")
    with pytest.raises(Exception, match="malformed record"):
        read_indicator_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()


def many_splits(spark, size):
    """Splits of ``size`` bytes while the context lasts."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}

    @contextlib.contextmanager
    def changed():
        for name, value in names.items():
            spark.conf.set(name, value)
        try:
            yield
        finally:
            for name in names:
                spark.conf.unset(name)
    return changed()


@pytest.mark.parametrize("size", [7, 64, 4096, 1 << 20])
def test_line_breaks_across_splits(spark, tmp_path, size):
    """Records that begin in one split and end in another, some over several, as one task reads them."""
    draw = random.Random(size)
    def text():
        return '"' + "".join(draw.choice(["a", ",", "\n", '""', " x", "\r\n", "é"]) for _ in range(draw.randrange(30))) + '"'
    for name, rows in (("a", 300 if size > 7 else 30), ("b", 40), ("c", 0)):
        body = "".join(f"{text()},{draw.choice(['1', '2.5', 'NA', ''])},{draw.choice(['z', text()])}\n" for _ in range(rows))
        (tmp_path / f"{name}.csv").write_text(f"name,n,note\n{body}" + ("\n\n" if name == "b" else ""), newline="")
    want = sorted(map(repr, read_indicator_csv(spark, str(tmp_path), SCHEMA).collect()))
    with many_splits(spark, size):
        got = read_indicator_csv(spark, str(tmp_path), SCHEMA, splittable=True)
        assert sorted(map(repr, got.collect())) == want
        tasks = spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions()
        assert size > 4096 or tasks > 1


def test_split_quarantine_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n,note\nok,1,"a, b\nc"\nlong,2,a, b\nshort,3\nbad,abc,x\nopen,1,"rest\nof,it\n')
    with many_splits(spark, 16):
        good, bad = read_with_quarantine(spark, str(tmp_path), SCHEMA, splittable=True)
        assert [tuple(r) for r in good.filter("name = 'ok'").collect()] == [("ok", 1.0, "a, b\nc")]
        assert {"bad,abc,x", "long,2,a, b", "short,3"} <= {r.corrupt_line for r in bad.collect()}
        with pytest.raises(Exception, match="malformed record"):
            read_indicator_csv(spark, str(tmp_path), SCHEMA, splittable=True).collect()
        (tmp_path / "b.csv").write_text("name,note,n\nx,y,1\n")
        with pytest.raises(Exception, match="another header"):
            read_indicator_csv(spark, str(tmp_path), SCHEMA, splittable=True).collect()


def test_quarantine_keeps_whole_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n,note\na,1,x\x01,extra,fields\nb,2,y\x01z\nc,3,"p\nq"\n')
    good, bad = read_with_quarantine(spark, str(tmp_path), SCHEMA)
    assert [r.corrupt_line for r in bad.collect()] == ["a,1,x\x01,extra,fields"]
    assert sorted(tuple(r) for r in good.collect()) == [("b", 2.0, "y\x01z"), ("c", 3.0, "p\nq")]


def test_a_dominant_period_takes_many_tasks(spark, tmp_path):
    path, size = str(tmp_path / "big"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(0, 400000, 1, 64).selectExpr("2024 AS period", "id", "uuid() AS text")
    spark.conf.set(size, "64k")
    try:
        write_table(rows, path, partition_by=["period"])
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "big" / "period=2024").glob("*.parquet"))) > 32
    assert spark.read.parquet(path).count() == 400000


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["Año", "Variación %", "valorTotal", "2024", "año"])
    assert clean_names(df).columns == ["ano", "variacion_percent", "valor_total", "x2024", "ano_2"]


def test_resolve_columns(spark):
    df = spark.createDataFrame([("a", 2024, 3.0)], ["grupo", "vigencia", "conteo"])
    assert resolve_columns(df, ACTOR_ALIASES).columns == ["actor", "year", "total"]
    without_actor = spark.createDataFrame([(2025, 27121.0)], ["year", "total"])
    with pytest.raises(ColumnsMissing, match="actor"):
        resolve_columns(without_actor, ACTOR_ALIASES)
    picked = resolve_columns(without_actor, {"total": ["^tot"], "actor": ["grupo"]}, mode="regex",
                             optional={"actor": "string"})
    assert picked.dtypes == [("total", "double"), ("actor", "string")]
    with pytest.raises(ColumnsMissing):
        validate_schema(df, ["grupo", "absent"])


def test_standardize_long(spark):
    df = spark.createDataFrame([("Estado", "x", "2025.0", "7,5", "kg", "NA")],
                               ["Categoria", "Indicador", "Año", "Valor", "Unidad", "variacion_porcentual"])
    long = standardize_long(df)
    assert long.columns == LONG_SCHEMA.fieldNames()
    assert tuple(long.first()) == ("Estado", "x", 2025, None, "kg", None, None, None)


def test_write_and_read_back(spark, tmp_path, long_df):
    path = str(tmp_path / "long")
    write_table(long_df, path, partition_by=["period"])
    back = spark.read.parquet(path)
    assert back.filter("period = 2024").count() == 4 and back.count() == 32
    write_table(long_df.select("category", "indicator", "value"), str(tmp_path / "csv"), fmt="csv", order_by=["indicator"])
    schema = T.StructType([LONG_SCHEMA[c] for c in ("category", "indicator", "value")])
    read = read_indicator_csv(spark, str(tmp_path / "csv"), schema)
    assert read.exceptAll(long_df.select("category", "indicator", "value")).count() == 0
    assert read.count() == 32


def test_guards(spark, long_df):
    assert quality.assert_complete(long_df, ["category", "period"]) is long_df
    with pytest.raises(ValueError, match="value"):
        quality.assert_complete(long_df, ["value"])
    with pytest.raises(ValueError, match="no rows"):
        quality.assert_complete(long_df.filter("period = 1900"))
    assert panels.drop_invalid(long_df, ["indicator", "value"]).count() == 22


def test_durable_uses_the_named_folder(spark, tmp_path, long_df):
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if not spark.conf.get("spark.checkpoint.dir", None) else None
    assert durable(long_df).count() == 32
