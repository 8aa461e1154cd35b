"""Reading and writing indicator tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from panelwright.functions import blank_to_null

LONG_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("indicator", T.StringType()),
    T.StructField("period", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("reported_pct", T.DoubleType()),
    T.StructField("notes", T.StringType()),
    T.StructField("missing_type", T.StringType()),
])


class ColumnsMissing(ValueError):
    """A table lacks columns that an operator requires."""


#: One form for reading and writing: quotes are doubled, line breaks stand in quotes, blanks are kept.
CSV = {"quote": '"', "escape": '"', "nullValue": "NA"}
_MALFORMED = "_malformed"


def _split_records(spark: SparkSession, path: str) -> DataFrame:
    """record, first: the text of every record and whether it is the first of its file.

    Files are read line by line in splits. A line begins a record if an even number of quotes stands
    before it in its file: the count within the split, a window bounded by the split's size, plus the
    parity of the splits before, one row per split. Lines that are whole records are done; the others,
    keyed by the line that opened their record, also one in an earlier split, are put together.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        (F.length(F.regexp_replace("value", '[^"]', "")) % 2).alias("odd"))
    split, earlier = ["file", "block"], Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    before = lines.groupBy(*split).agg(F.sum("odd").alias("odds")).select(
        *split, (F.coalesce(F.sum("odds").over(earlier), F.lit(0)) % 2).alias("before"))
    so_far = Window.partitionBy(*split).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Counted within the split first, so that only one row per split meets the parities before it.
    counted = lines.withColumn("after", F.sum("odd").over(so_far)).withColumn(
        "first", (F.col("block") == 0) & (F.row_number().over(so_far) == 1))
    placed = counted.join(before, split).withColumn("after", (F.col("after") + F.col("before")) % 2)
    placed = placed.withColumn("begins", F.col("after") == F.col("odd"))
    whole = placed.filter("begins AND after = 0").select(F.col("value").alias("record"), "first")
    opened = F.last(F.when(F.col("begins"), F.col("line")), ignorenulls=True).over(so_far)
    parts = placed.filter("NOT (begins AND after = 0)").withColumn("opened", opened)
    # A line without an opener in its split belongs to the last record opened in an earlier one.
    openers = before.join(parts.groupBy(*split).agg(F.max("opened").alias("last")), split, "left")
    openers = openers.select(
        *split, F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("block"), F.col("last"))), ignorenulls=True).over(earlier).alias("open"))
    owner = F.when(F.col("opened").isNotNull(), F.struct("block", F.col("opened").alias("last"))).otherwise(F.col("open"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = parts.join(openers, split).groupBy("file", owner.alias("owner")).agg(
        F.array_join(F.transform(pieces, lambda piece: piece["value"]), "\n").alias("record"), F.bool_or("first").alias("first"))
    records = whole.union(joined.select("record", "first"))
    return records.withColumn("record", F.regexp_replace("record", "\\r$", ""))


def _records(
    spark: SparkSession, path: str, schema: T.StructType, header: bool, multi_line: bool, splittable: bool = False
) -> tuple[DataFrame, list[str]]:
    """All fields as text, found by name, and the text of records with too few or too many fields."""
    options = {**CSV, "header": header, "multiLine": multi_line, "enforceSchema": False}
    names = schema.fieldNames()
    if header:
        present = spark.read.options(**{**options, "multiLine": multi_line and not splittable}).csv(path).columns
        missing = [name for name in names if name not in present]
        if missing:
            raise ColumnsMissing(f"no column {', '.join(missing)} among {', '.join(present)}")
        names = present
    text = T.StructType([T.StructField(name, T.StringType()) for name in [*names, _MALFORMED]])
    if splittable:
        ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in text.fieldNames())
        form = {**CSV, "columnNameOfCorruptRecord": _MALFORMED}
        records = _split_records(spark, path).filter(F.trim("record") != "")
        records = records.withColumn("fields", F.from_csv("record", ddl, form))
        if header:
            found = F.array(*[F.col("fields").getField(name) for name in names])
            same = F.coalesce(found == F.array(*[F.lit(name) for name in names]), F.lit(False))
            differs = F.raise_error(F.concat(F.lit("another header: "), F.col("record"))).cast("boolean")
            records = records.filter(F.when(~F.col("first"), True).when(same, False).otherwise(differs))
        return records.select(*[F.col("fields").getField(name).alias(name) for name in text.fieldNames()]), names
    # Without column pruning every record is split into all its fields, so their number is checked.
    reader = spark.read.options(**options, columnPruning=False, columnNameOfCorruptRecord=_MALFORMED)
    return reader.schema(text).csv(path), names


def _parsed(name: str, kind: T.DataType) -> Column:
    return blank_to_null(name) if isinstance(kind, T.StringType) else F.expr(
        f"try_cast(trim(`{name}`) AS {kind.simpleString()})")


def _checked(records: DataFrame, names: Sequence[str], schema: T.StructType) -> DataFrame:
    """``row``, the record as declared, and ``bad``, its text if it cannot be read so."""
    unread = F.lit(False)
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            unread = unread | (blank_to_null(f.name).isNotNull() & _parsed(f.name, f.dataType).isNull())
    line = F.to_csv(F.struct(*[F.col(f"`{name}`") for name in names]), {**CSV, "emptyValue": ""})
    return records.select(
        F.struct(*[_parsed(f.name, f.dataType).alias(f.name) for f in schema.fields]).alias("row"),
        F.coalesce(F.col(_MALFORMED), F.when(unread, line)).alias("bad"))


def read_indicator_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True, splittable: bool = False
) -> DataFrame:
    """CSV with a header; columns are found by name, others in the file are left out.

    Empty text, quoted empty text and ``NA`` all mean missing. The files must agree in their
    header. A record with too few or too many fields, or with a field that does not parse, fails
    the read with its text; ``read_with_quarantine`` sets such records aside. With ``multi_line``
    quoted fields may hold line breaks and a file is read by one task; tables without them can
    switch it off, and then large files are split. With ``splittable`` large files are split and
    quoted fields may hold line breaks; then every quote must enclose a field or be doubled within
    one, in UTF-8, and the header must be one line.
    """
    records, names = _records(spark, path, schema, True, multi_line, splittable)
    failed = F.raise_error(F.concat(F.lit("malformed record: "), F.col("bad"))).cast(schema)
    rows = _checked(records, names, schema).select(F.when(F.col("bad").isNull(), F.col("row")).otherwise(failed).alias("row"))
    return rows.select(*[F.col(f"row.{name}").alias(name) for name in schema.fieldNames()])


def read_with_quarantine(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, multi_line: bool = True,
    splittable: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Split a CSV into well-formed rows and the text of malformed records.

    A record is malformed when it has too few or too many fields or a field that does not parse.
    With a header, columns are found by name; without one, by place. ``splittable`` as in
    ``read_indicator_csv``.
    """
    records, names = _records(spark, path, schema, header, multi_line, splittable)
    checked = _checked(records, names, schema)
    good = checked.filter(F.col("bad").isNull()).select(*[F.col(f"row.{name}").alias(name) for name in schema.fieldNames()])
    return good, checked.filter(F.col("bad").isNotNull()).select(F.col("bad").alias("corrupt_line"))


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    order_by: Sequence[str | Column] = (),
    mode: str = "overwrite",
) -> None:
    """Write a result table, the only place where a global order is made.

    With ``partition_by`` the rows are rebalanced by those columns: adaptive execution puts small
    values together and splits a dominant one by its size into as many tasks as it needs.
    """
    if order_by:
        df = df.orderBy(*order_by)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
        writer.options(**CSV, **kept, header=True, quoteAll=True).csv(path)
    else:
        writer.format(fmt).save(path)


def _checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode without it."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelwright-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, inside the checkpoint folder."""
    return f"{_checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, for a table several models read."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back: later plans read their columns only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
