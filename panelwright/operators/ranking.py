"""Exact ranks and running totals inside groups of any size, by one sort.

A window over a group puts the whole group into one task, and the groups here are few and huge
(three markets, millions of entities each). The rows are therefore dealt to ranges of (group, value
from the largest down), and each task walks its own range:

* *local*: places, sums and distinct values counted from the start of the range, for its groups.
* *parts*: one row per range and group, from which the totals of groups come.
* *carry*: what earlier ranges hold of the group a range begins with. Only the first group of a range
  can have begun before, so this is one row per range, and it is added to the rows of that group.

The rows are shuffled once, sorted once and, where the carry goes back to them, written once into the
shared folder; a lost task is repeated from there. Ranges follow the data: Spark samples the keys, and a
value that holds most rows is either collapsed before the shuffle, where only its count matters, or
spread over many ranges by what else the rows hold. The count of ranges is that of shuffle
partitions. Running totals are the one step that needs Python: Arrow batches in order, with a few
numbers kept from one to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelwright.functions import is_finite
from panelwright.sources import written

#: Arrow batches a task puts together before it collapses equal values.
COMBINED_BATCHES = 32

_LOCAL = [("_above_rows", T.LongType()), ("_above_values", T.LongType()), ("_end_rows", T.LongType()),
          ("_end_mass", T.DoubleType()), ("_first", T.BooleanType())]


def measure(value: str) -> Column:
    """The value as ranked: finite, not negative. ``greatest`` only meets values here, never NULL."""
    return F.when(is_finite(value), F.greatest(F.col(value).cast("double"), F.lit(0.0)))


class Grouping:
    """The grouping columns in a form that is never NULL, and the way back.

    A NULL group is a group like any other. Joins on nullable columns would lose it, and a
    null-safe join does not use the partitioning the windows leave behind, so each column
    becomes a filled column and a flag.
    """

    def __init__(self, df: DataFrame, by: Sequence[str]):
        self.columns: dict[str, Column] = {} if by else {"_g": F.lit(0)}
        self.restored: list[Column] = []
        for i, name in enumerate(by):
            self.columns[f"_g{i}"] = F.coalesce(F.col(name), _filler(df.schema[name].dataType))
            self.columns[f"_n{i}"] = F.col(name).isNull()
            self.restored.append(F.when(~F.col(f"_n{i}"), F.col(f"_g{i}")).alias(name))
        self.names = list(self.columns)

    def selected(self) -> list[Column]:
        return [c.alias(name) for name, c in self.columns.items()]


def _filler(kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)


def _combine(keys: list[str], batches_held: int) -> Callable:
    """Collapse equal (group, value) rows of a few batches into one with its count, before any shuffle."""
    def run(batches):
        import pyarrow as pa

        def collapsed(held):
            table = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([([], "count_all")])
            yield from table.select([*keys, "count_all"]).rename_columns([*keys, "rows"]).to_batches()

        held = []
        for batch in batches:
            held.append(batch)
            if len(held) == batches_held:
                yield from collapsed(held)
                held = []
        if held:
            yield from collapsed(held)

    return run


def value_counts(df: DataFrame, groups: Grouping, value: str) -> DataFrame:
    """(group, _x, rows): values and how often they occur, collapsed within tasks but not across them."""
    x = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    rows = df.filter(is_finite(value)).select(*groups.selected(), (x + F.lit(0.0)).alias("_x"))
    schema = T.StructType([*rows.schema.fields, T.StructField("rows", T.LongType())])
    return rows.mapInArrow(_combine(rows.columns, COMBINED_BATCHES), schema)


def _walk(grp: list[str], weight: str | None) -> Callable:
    """Places and sums of sorted rows within their task, group by group."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        group, last_x, ordinal = None, None, 0
        rows, values, mass, above = 0, 0, 0.0, (0, 0)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            x = batch.column("_x").to_numpy(zero_copy_only=False)
            known = ~np.isnan(x)
            w = np.where(known, batch.column(weight).to_numpy() if weight else 1, 0).astype(np.int64)
            wx = w * np.where(known, x, 0.0)
            changed = np.zeros(size, bool)
            for name in grp:
                column = batch.column(name)
                differ = pc.not_equal(column.slice(1), column.slice(0, size - 1)).to_numpy(zero_copy_only=False)
                if pa.types.is_floating(column.type):
                    nan = np.isnan(column.to_numpy())
                    differ = differ & ~(nan[1:] & nan[:-1])
                changed[1:] |= differ
            here = [batch.column(name)[0].as_py() for name in grp]
            changed[0] = group is None or any(a != b and (a == a or b == b) for a, b in zip(here, group))
            starts, segment = np.flatnonzero(changed), np.cumsum(changed)
            fresh = changed.copy()
            fresh[1:] |= x[1:] != x[:-1]
            fresh[0] |= x[0] != last_x
            fresh &= known

            def running(steps, carried):
                total = np.cumsum(steps)
                return total - np.concatenate(([-carried], (total - steps)[starts]))[segment]

            end_rows, end_values = running(w, rows), running(fresh.astype(np.int64), values)
            # Sums are taken group by group, so that a small group does not follow a large one's rounding.
            end_mass, edges = np.empty(size), [*([] if changed[0] else [0]), *starts.tolist(), size]
            for begin, end in zip(edges, edges[1:]):
                np.cumsum(wx[begin:end], out=end_mass[begin:end])
            if not changed[0]:
                end_mass[:edges[1]] += mass
            run_of, at = np.cumsum(fresh), np.flatnonzero(fresh)
            above_rows = np.concatenate(([above[0]], (end_rows - w)[at]))[run_of]
            above_values = np.concatenate(([above[1]], (end_values - 1)[at]))[run_of]
            first = ordinal + segment == 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(above_rows), pa.array(above_values), pa.array(end_rows), pa.array(end_mass),
                 pa.array(first)],
                [*batch.schema.names, "_above_rows", "_above_values", "_end_rows", "_end_mass", "_first"])
            group, last_x = [batch.column(name)[size - 1].as_py() for name in grp], x[-1]
            rows, values, mass = int(end_rows[-1]), int(end_values[-1]), float(end_mass[-1])
            above, ordinal = (int(above_rows[-1]), int(above_values[-1])), ordinal + int(segment[-1])

    return run


def _ranged(rows: DataFrame, grp: list[str], ties: Sequence[Column], weight: str | None) -> DataFrame:
    """``rows`` (group, _x, ...) in ranges, with ``_part``, the number of the range, and local totals."""
    keys = [*[F.col(c) for c in grp], F.col("_x").desc_nulls_last(), *ties]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, *[T.StructField(name, kind) for name, kind in _LOCAL]])
    return ordered.mapInArrow(_walk(grp, weight), schema)


def _parts(local: DataFrame, grp: list[str], *sums: Column) -> DataFrame:
    """One row per range and group with what earlier ranges hold of the group."""
    parts = local.filter(F.col("_x").isNotNull()).groupBy("_part", *grp).agg(
        F.max("_end_rows").alias("rows"), F.max("_end_mass").alias("mass"), (F.max("_above_values") + 1).alias("values"),
        F.max("_x").alias("top"), F.min("_x").alias("last"), F.max("_above_rows").alias("above_last"),
        F.bool_or("_first").alias("first"), *sums)
    ordered = Window.partitionBy(*grp).orderBy("_part")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)

    def before(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    goes_on = F.coalesce(F.lag("last").over(ordered) == F.col("top"), F.lit(False))
    tied = F.sum(F.col("rows") - F.col("above_last")).over(Window.partitionBy(*grp, "last").orderBy("_part"))
    marked = parts.withColumns({"goes_on": goes_on, "tied": tied})
    return marked.withColumns({
        "rows_before": before(F.col("rows")),
        "mass_before": before(F.col("mass")),
        "values_before": before(F.col("values") - F.col("goes_on").cast("int")),
        "tied_before": F.when(F.col("goes_on"), F.lag("tied").over(ordered)).otherwise(F.lit(0)),
    })


def _global(local: DataFrame, grp: list[str]) -> DataFrame:
    """Local totals with the carry added, and ``group_rows`` and ``group_mass``.

    The local totals are written once and read twice: Spark draws the borders of ranges anew whenever it
    plans them, so totals and rows from two plans would not fit together.
    """
    local = written(local, "ranges")
    parts = _parts(local, grp)
    totals = parts.groupBy(*grp).agg(F.sum("rows").alias("group_rows"), F.sum("mass").alias("group_mass"))
    # One row per range at most.
    carry = parts.filter("first").select(
        "_part", "top", "rows_before", "mass_before", "tied_before",
        (F.col("values_before") - F.col("goes_on").cast("int")).alias("values_before"))
    joined = local.join(F.broadcast(carry), "_part", "left")

    def carried(c: str) -> Column:
        return F.when(F.col("_first"), F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0))

    tied = F.when(F.col("_x") == F.col("top"), carried("tied_before")).otherwise(F.lit(0))
    placed = joined.withColumns({
        "_above_rows": F.col("_above_rows") + carried("rows_before") - tied,
        "_above_values": F.col("_above_values") + carried("values_before"),
        "_end_rows": F.col("_end_rows") + carried("rows_before"),
        "_end_mass": F.col("_end_mass") + carried("mass_before"),
    })
    return placed.drop("_part", "_first", *[c for c in carry.columns if c != "_part"]).join(totals, grp, "left")


def value_ranks(df: DataFrame, groups: Grouping, value: str) -> DataFrame:
    """Values of each group with their places, under the names of ``groups``.

    ``x`` the value, ``rows`` how many rows of it, ``above_rows`` the rows placed before them,
    ``above_values`` the distinct values greater than it, and ``group_rows`` / ``group_mass`` of the
    whole group. A value may come in several rows, which follow each other in their places. NULL and
    non-finite values do not take part; negative ones count as zero.
    """
    ranks = _global(_ranged(value_counts(df, groups, value), groups.names, [], "rows"), groups.names)
    return ranks.select(
        *groups.names, F.col("_x").alias("x"), "rows", (F.col("_end_rows") - F.col("rows")).alias("above_rows"),
        F.col("_above_values").alias("above_values"), "group_rows", "group_mass")


def group_places(df: DataFrame, groups: Grouping, value: str) -> DataFrame:
    """Per group ``rows``, ``mass`` and ``placed``, the sum of place times value from the largest down.

    Only sums of ranges are needed, so nothing is joined to rows. In doubles: rows times places exceeds
    a bigint from some billions of equal rows on.
    """
    local = _ranged(value_counts(df, groups, value), groups.names, [], "rows")
    n, end = F.col("rows").cast("double"), F.col("_end_rows").cast("double")
    parts = _parts(local, groups.names, F.sum(F.col("_x") * (n * end - n * (n - 1) / 2)).alias("placed"))
    return parts.groupBy(*groups.names).agg(
        F.sum("rows").alias("rows"), F.sum("mass").alias("mass"),
        F.sum(F.col("rows_before") * F.col("mass") + F.col("placed")).alias("placed"))


def attach_ranks(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Put the ranks of its value on every row, as the struct ``ranks``; it is NULL without a value.

    ``x`` the value, ``above_rows`` and ``above_values`` the rows and distinct values greater than it,
    ``running_mass`` the sum from the largest row down to this one, and ``group_rows`` / ``group_mass``.
    Rows of equal value follow each other in the order of ``ties``, else by a hash of the whole row,
    which also spreads a frequent value over ranges.
    """
    groups = Grouping(df, by)
    ties = list(ties) or [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    named = [f"_tie{i}" for i in range(len(ties))]
    keyed = df.withColumns({**groups.columns, "_x": measure(value), **dict(zip(named, ties))})
    ranked = _global(_ranged(keyed, groups.names, [F.col(c) for c in named], None), groups.names)
    found = F.struct(
        F.col("_x").alias("x"), F.col("_above_rows").alias("above_rows"), F.col("_above_values").alias("above_values"),
        F.col("_end_mass").alias("running_mass"), "group_rows", "group_mass")
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_x").isNotNull(), found).alias("ranks"))


def top_values(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """The ``k`` largest distinct values of each group: names of the group, ``x``, ``rows`` and ``place``.

    A task collapses equal values and keeps ``k`` distinct ones of each group, so what is shuffled
    does not follow the rows, not even when most rows share the largest value.
    """
    groups = Grouping(df, by)
    place = F.dense_rank().over(Window.partitionBy(*groups.names).orderBy(F.col("_x").desc()))
    top = value_counts(df, groups, value).withColumn("place", place).filter(F.col("place") <= k)
    return top.groupBy(*groups.names, "place").agg(F.max("_x").alias("x"), F.sum("rows").alias("rows"))


def top_k_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[Column], k: int = 10) -> DataFrame:
    """The first ``k`` rows of each group, with their place as ``place``.

    The bound on ``row_number`` lets Spark keep only ``k`` rows per group and task before the
    shuffle. ``order_by`` must be a total order, or ties are cut arbitrarily.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))
    return df.withColumn("place", place).filter(F.col("place") <= k)
