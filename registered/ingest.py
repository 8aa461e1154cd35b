"""Sources, sinks and cleaning."""

from pyspark.sql import functions as F, types as T

from panelwright.functions import blank_to_null, finite_or_null, normalize_key, to_int, to_number
from panelwright.operators import metrics, panel as panels, quality
from panelwright.presets import ACTOR_ALIASES
from panelwright.sources import (
    LONG_SCHEMA,
    clean_names,
    read_indicator_csv,
    read_with_quarantine,
    resolve_columns,
    scratch_path,
    standardize_actor,
    standardize_long,
    validate_schema,
    write_table,
)
from registered.base import (
    BASE, CURRENT, PERIODS, cte, customer_long, customer_panel, nation_long, query, ship_years, sql, supplier_panel, table,
)

# The unit is missing in three ways, the notes hold commas and quotes.
cte("messy_long", ("customer_long",), """
SELECT category, indicator, period, value,
       CASE WHEN period % 3 = 2 THEN 'cents' END AS unit, reported_pct,
       CASE WHEN period % 2 = 0 THEN 'from "orders", summed' END AS notes, CAST(NULL AS VARCHAR) AS missing_type
FROM customer_long""")


def messy_long(spark, sf_dir):
    unit = F.when(F.col("period") % 3 == 0, "").when(F.col("period") % 3 == 1, "NA").otherwise("cents")
    notes = F.when(F.col("period") % 2 == 0, 'from "orders", summed')
    return customer_long(spark, sf_dir).select(
        "category", "indicator", "period", "value", unit.alias("unit"), "reported_pct",
        notes.alias("notes"), F.lit(None).cast("string").alias("missing_type"),
    )


@query("src1_read_indicator_csv", sql("messy_long", "SELECT * FROM messy_long"))
def read_csv(spark, sf_dir):
    path = scratch_path(spark, "long-csv")
    writer = messy_long(spark, sf_dir).write.option("header", True).option("escape", '"')
    writer.option("nullValue", "NA").csv(path)
    return read_indicator_csv(spark, path, LONG_SCHEMA)


@query("src1_read_permuted_csv", sql("messy_long", "SELECT * FROM messy_long"))
def read_permuted_csv(spark, sf_dir):
    """The columns in another order, and one more that nothing asks for."""
    path = scratch_path(spark, "permuted-csv")
    rows = messy_long(spark, sf_dir)
    write_table(rows.select(*reversed(rows.columns), F.lit(1).alias("surplus")), path, fmt="csv")
    return read_indicator_csv(spark, path, LONG_SCHEMA)


@query("src1_read_split_csv", sql("messy_long", """
SELECT category, indicator, period, value, unit, reported_pct, missing_type,
       CASE WHEN period % 2 = 0 THEN notes ELSE 'line one' || chr(10) || '"' || period || '", last' END AS notes
FROM messy_long"""))
def read_split_csv(spark, sf_dir):
    """Fields with line breaks, quotes and commas, in files that many tasks may share."""
    path = scratch_path(spark, "split-csv")
    broken = F.concat(F.lit('line one\n"'), F.col("period").cast("string"), F.lit('", last'))
    rows = messy_long(spark, sf_dir)
    write_table(rows.withColumn("notes", F.when(F.col("period") % 2 == 0, F.col("notes")).otherwise(broken)), path, fmt="csv")
    return read_indicator_csv(spark, path, LONG_SCHEMA, splittable=True)


LINE_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("indicator", T.StringType()),
    T.StructField("period", T.IntegerType()), T.StructField("value", T.DoubleType()),
    T.StructField("notes", T.StringType()),
])


@query("src2_read_with_quarantine", sql("customer_long", """
SELECT CASE WHEN period % 4 = 3 THEN 'bad' ELSE 'good' END AS status, category,
       CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT indicator) AS BIGINT) AS n_indicators,
       CASE WHEN period % 4 = 3 THEN NULL ELSE sum(value) END AS total
FROM customer_long GROUP BY 1, 2, period % 4 = 3"""))
def quarantine(spark, sf_dir):
    """Rows whose note has an unquoted comma have one field too many."""
    path = scratch_path(spark, "long-lines")
    note = F.when(F.col("period") % 4 == 3, "over\u0001, half").otherwise("plain\u0001x")
    number = F.coalesce(F.col("value").cast("string"), F.lit("NA"))
    rows = customer_long(spark, sf_dir).select(
        F.concat_ws(",", "category", "indicator", F.col("period").cast("string"), number, note).alias("value")
    )
    # Every part file of a CSV table has its own header line.
    rows.write.option("header", False).text(path)
    good, bad = read_with_quarantine(spark, path, LINE_SCHEMA, header=False)
    fields = F.split("corrupt_line", ",")
    both = good.select(F.lit("good").alias("status"), "category", "indicator", "value").unionByName(
        bad.select(F.lit("bad").alias("status"), fields[0].alias("category"), fields[1].alias("indicator"),
                   F.lit(None).cast("double").alias("value"))
    )
    return both.groupBy("status", "category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("indicator").alias("n_indicators"),
        F.sum("value").alias("total"),
    )


@query("src4_validate_schema", sql("supplier_panel", "SELECT actor, period, total FROM supplier_panel"))
def validated(spark, sf_dir):
    """The check reads the schema only; the rows pass through."""
    required = ["actor", "period", "total"]
    return validate_schema(supplier_panel(spark, sf_dir), required).select(*required)


@query("snk1_write_table", sql("customer_long", """
SELECT category, indicator, period, value, reported_pct FROM customer_long"""))
def write_and_read(spark, sf_dir):
    """Written by period and read back whole, every folder of it."""
    path = scratch_path(spark, "long-parquet")
    long = customer_long(spark, sf_dir).select("category", "indicator", "period", "value", "reported_pct")
    write_table(long, path, partition_by=["period"])
    return spark.read.parquet(path)


@query("snk1_write_table_csv", sql("customer_long", """
SELECT category, indicator, period, value, unit,
       CASE WHEN period % 2 = 0 THEN 'from "orders",' || chr(10) || ' summed' || chr(1) || ', ' || indicator END AS notes
FROM customer_long"""))
def write_and_read_csv(spark, sf_dir):
    """Notes with quotes, commas, line breaks and a control character."""
    path = scratch_path(spark, "long-csv-sink")
    columns = ["category", "indicator", "period", "value", "unit", "notes"]
    notes = F.when(F.col("period") % 2 == 0, F.concat(F.lit('from "orders",\n summed\u0001, '), F.col("indicator")))
    write_table(customer_long(spark, sf_dir).withColumn("notes", notes).select(*columns), path, fmt="csv")
    return read_indicator_csv(spark, path, T.StructType([LONG_SCHEMA[c] for c in columns]))


@query("snk3_run_metadata", sql("customer_panel", """
SELECT 'concentration' AS model, '1.0' AS version, 'customer_panel' AS source, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT indicator) AS BIGINT) AS n_distinct, 'stock;growth' AS markets FROM customer_panel"""))
def metadata(spark, sf_dir):
    run = metrics.run_metadata(customer_panel(spark, sf_dir), "concentration", "1.0", "indicator",
                               "customer_panel", {"markets": "stock;growth"})
    return run.drop("run_at")


@query("snk4_metrics_long", sql("customer_panel", """
SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM customer_panel
UNION ALL SELECT 'net', CAST(sum(delta_abs) AS DOUBLE) FROM customer_panel
UNION ALL SELECT 'largest', max(value_current) FROM customer_panel"""))
def long_metrics(spark, sf_dir):
    wide = customer_panel(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("delta_abs").alias("net"), F.max("value_current").alias("largest")
    )
    return metrics.metrics_long(wide)


@query("cln01_clean_names", """
SELECT o_orderkey AS order_key, o_totalprice AS total_price_percent, o_orderpriority AS ano, o_orderstatus AS ano_2
FROM orders""")
def cleaned_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
    return clean_names(orders.select(*columns).toDF("orderKey", " Total price %", "Año", "año"))


@query("cln03_resolve_regex", sql("supplier_panel", """
SELECT actor, period, total, CAST(NULL AS VARCHAR) AS notes FROM supplier_panel"""))
def resolve_regex(spark, sf_dir):
    """Headers that contain the wanted words, and one target that nothing matches."""
    raw = supplier_panel(spark, sf_dir).select(
        F.col("actor").alias("grupo_x"), F.col("period").alias("vigencia_fiscal"),
        F.col("total").alias("conteo_total"), "support",
    )
    patterns = {"actor": ["^gao$", "grupo"], "period": ["^year$", "vigencia"], "total": ["^total$", "conteo"],
                "notes": ["nota"]}
    return resolve_columns(raw, patterns, mode="regex", optional={"notes": "string"})


@query("cln02_resolve_alias", sql("supplier_panel", """
SELECT 'actor ' || CAST(actor AS VARCHAR) AS actor, period AS year, total FROM supplier_panel"""))
def resolve_alias(spark, sf_dir):
    raw = supplier_panel(spark, sf_dir).select(
        F.concat(F.lit("actor "), F.col("actor").cast("string")).alias("grupo_armado"),
        F.col("period").alias("periodo"), F.col("total").alias("casos"),
    )
    return validate_schema(resolve_columns(raw, ACTOR_ALIASES), ["actor", "year", "total"])


@query("cln04_normalize_key", """
SELECT p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || '   ' || p_brand || ' ', '\\s+', ' ', 'g'))) AS key
FROM part""")
def normalized(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   "), F.col("p_brand"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", normalize_key(raw).alias("key"))


@query("cln04_normalize_text", r"""
SELECT lang, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(length(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS BIGINT) AS n_chars
FROM documents GROUP BY lang""")
def normalized_text(spark, sf_dir):
    """The same key over long texts, whole."""
    length = F.length(normalize_key("text")).cast("bigint")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(length).alias("n_chars")
    )


# Numbers as text in five shapes, by order key.
cte("text_numbers", (), """
SELECT o_orderkey, CASE o_orderkey % 5
         WHEN 0 THEN CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)
         WHEN 1 THEN ' ' || CAST(year(o_orderdate) AS VARCHAR) || '.7 '
         WHEN 2 THEN 'abc' WHEN 3 THEN '' ELSE 'NA' END AS text
FROM orders""")


def text_numbers(spark, sf_dir):
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"))
        .when(kind == 1, F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(".7 ")))
        .when(kind == 2, "abc").when(kind == 3, "").otherwise("NA")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


@query("cln05_to_number", sql("text_numbers", """
SELECT o_orderkey, TRY_CAST(trim(text) AS DOUBLE) AS number,
       CAST(trunc(TRY_CAST(trim(text) AS DOUBLE)) AS INTEGER) AS whole FROM text_numbers"""))
def numbers(spark, sf_dir):
    return text_numbers(spark, sf_dir).select(
        "o_orderkey", to_number("text").alias("number"), to_int("text").alias("whole")
    )


@query("cln06_drop_invalid", sql("text_numbers", """
SELECT o_orderkey, trim(text) AS text FROM text_numbers WHERE text IS NOT NULL AND text <> '' AND text <> 'NA'"""))
def valid_rows(spark, sf_dir):
    rows = text_numbers(spark, sf_dir).withColumn("text", blank_to_null("text"))
    return panels.drop_invalid(rows, ["o_orderkey", "text"])


@query("cln07_standardize_long", sql("customer_long", """
SELECT category, indicator, period, value, unit, reported_pct, CAST(NULL AS VARCHAR) AS notes,
       CAST(NULL AS VARCHAR) AS missing_type FROM customer_long"""))
def standardized(spark, sf_dir):
    """Headers with accents, capitals and spaces, every column as text."""
    headers = ["Categoría", "Indicador", "AÑO", "Valor", "Unidad", "Variación porcentual"]
    long = customer_long(spark, sf_dir)
    # %.0f keeps the text of a whole double exact in every size.
    text = [F.format_string("%.0f", F.col(f.name)) if f.dataType == T.DoubleType() else F.col(f.name).cast("string")
            for f in long.schema.fields]
    raw = long.select(*[
        F.when(F.col(name).isNotNull(), t).alias(header) for name, t, header in zip(long.columns, text, headers)
    ])
    return panels.long_panel(standardize_long(raw))


@query("cln08_null_counts", sql("customer_long", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(value) AS BIGINT) AS null_value,
       CAST(count(*) - count(reported_pct) AS BIGINT) AS null_reported_pct FROM customer_long"""))
def null_profile(spark, sf_dir):
    return quality.null_counts(customer_long(spark, sf_dir), ["value", "reported_pct"])


@query("cln09_drop_all_null", sql("customer_long", """
SELECT category, indicator, period, value, reported_pct FROM customer_long
WHERE value IS NOT NULL OR reported_pct IS NOT NULL"""))
def without_empty(spark, sf_dir):
    return panels.drop_all_null(customer_long(spark, sf_dir), ["value", "reported_pct"]).drop("unit")


@query("cln10_replace_na", sql("customer_panel", """
SELECT category, indicator, coalesce(value_base, 0) AS value_base, coalesce(value_current, 0) AS value_current
FROM customer_panel"""))
def zero_filled(spark, sf_dir):
    filled = panels.replace_na(customer_panel(spark, sf_dir), ["value_base", "value_current"])
    return filled.select("category", "indicator", "value_base", "value_current")


@query("cln11_clip_nonneg", sql("customer_panel", """
SELECT category, indicator, CASE WHEN delta_abs < 0 THEN 0 ELSE delta_abs END AS delta_abs FROM customer_panel"""))
def clipped(spark, sf_dir):
    return panels.clip_columns(customer_panel(spark, sf_dir), ["delta_abs"]).select(
        "category", "indicator", "delta_abs"
    )


@query("cln12_finite_or_null", """
SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 1, 2) THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def finite(spark, sf_dir):
    kind = F.col("c_custkey") % 7
    raw = (
        F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf")))
        .when(kind == 2, F.lit(float("-inf"))).otherwise(F.col("c_acctbal"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", finite_or_null(raw).alias("balance"))


@query("cln13_period_filter", sql("nation_long", f"""
SELECT category, indicator, period, value FROM nation_long WHERE period IN ({BASE}, {CURRENT})"""))
def two_periods(spark, sf_dir):
    return panels.period_filter(nation_long(spark, sf_dir, PERIODS), PERIODS).drop("unit")


@query("cln14_latest_period", sql("supplier_panel", """
SELECT * FROM supplier_panel WHERE period = (SELECT max(period) FROM supplier_panel)"""))
def last_period(spark, sf_dir):
    return panels.latest_period(supplier_panel(spark, sf_dir), seen_in=ship_years(spark, sf_dir))


@query("cln15_lookup_scalar", sql("supplier_panel", """
SELECT actor, CASE WHEN count(*) FILTER (period = 1997 AND armed >= 100) = 1
         THEN CAST(max(CASE WHEN period = 1997 AND armed >= 100 THEN total END) AS DOUBLE)
         ELSE CAST(-1 AS DOUBLE) END AS total
FROM supplier_panel GROUP BY actor"""))
def looked_up(spark, sf_dir):
    """A supplier's total of 1997, unless its returns were small."""
    rows = supplier_panel(spark, sf_dir).withColumn("large", F.col("armed") >= 100)
    return panels.lookup_scalar(rows, {"period": 1997, "large": True}, "total", default=-1.0, by=["actor"])


@query("src5_standardize_actor", sql("supplier_panel", """
SELECT 'supplier ' || actor AS actor, period, CAST(total AS DOUBLE) AS total, CAST(armed AS DOUBLE) AS armed,
       CAST(NULL AS DOUBLE) AS support FROM supplier_panel WHERE actor % 10 <> 0"""))
def actors(spark, sf_dir):
    """Raw headers and text in every field; every tenth supplier has no name and is left out."""
    named = F.when(F.col("actor") % 10 != 0, F.concat(F.lit("  Supplier   "), F.col("actor"))).otherwise(F.lit(" "))
    raw = supplier_panel(spark, sf_dir).select(
        named.alias("Grupo Armado"), F.col("period").cast("string").alias("Año"),
        F.col("total").cast("string").alias("Conteo"), F.col("armed").cast("string").alias("Armed"))
    return standardize_actor(raw)
