"""Profiles, contracts and guards over long panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _share_null(nulls: str, rows: str) -> Column:
    return F.sum(nulls) / F.sum(rows)


def coverage_scoreboard(
    df: DataFrame,
    by: str = "category",
    indicator: str = "indicator",
    period: str = "period",
    value: str = "value",
    reported: str = "reported_pct",
) -> DataFrame:
    """Per category: indicators, rows, periods and the shares of missing values.

    Rows are counted per (category, indicator, period) first, so the distinct counts run
    over the reduced table and a dominant category is never in one task. NULL counts as
    a distinct value.
    """
    cells = df.groupBy(by, indicator, period).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(value).isNull()).alias("no_value"),
        F.count_if(F.col(reported).isNull()).alias("no_reported"),
    )

    def distinct(name: str) -> Column:
        return F.count_distinct(F.col(name)) + F.max(F.col(name).isNull().cast("int"))

    return cells.groupBy(by).agg(
        distinct(indicator).alias("n_indicators"),
        F.sum("rows").alias("n_rows"),
        distinct(period).alias("n_periods"),
        _share_null("no_value", "rows").alias("share_value_na"),
        _share_null("no_reported", "rows").alias("share_reported_na"),
    )


def indicator_contract(
    df: DataFrame,
    periods: Sequence[int],
    keys: Sequence[str] = ("category", "indicator", "unit"),
    period: str = "period",
    value: str = "value",
    reported: str = "reported_pct",
) -> DataFrame:
    """Per key: rows, the periods seen (``;``-joined), flags for wanted periods, missing shares."""
    cells = df.groupBy(*keys, period).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(value).isNull()).alias("no_value"),
        F.count_if(F.col(reported).isNull()).alias("no_reported"),
    )
    seen = F.sort_array(F.collect_list(F.col(period)))
    return cells.groupBy(*keys).agg(
        F.sum("rows").alias("n_rows"),
        F.array_join(seen.cast("array<string>"), ";").alias("periods"),
        *[F.coalesce(F.bool_or(F.col(period) == p), F.lit(False)).alias(f"has_{p}") for p in periods],
        _share_null("no_value", "rows").alias("share_value_na"),
        _share_null("no_reported", "rows").alias("share_reported_na"),
    )


def indicator_dictionary(df: DataFrame, keys: Sequence[str] = ("category", "indicator", "unit")) -> DataFrame:
    return df.select(*keys).distinct()


def ingest_profile(
    df: DataFrame,
    control_indicator: str,
    control_period: int,
    category: str = "category",
    indicator: str = "indicator",
    period: str = "period",
    value: str = "value",
) -> DataFrame:
    """One row: rows, columns, categories, indicators and a control total."""
    control = (F.col(indicator) == control_indicator) & (F.col(period) == control_period)
    pairs = df.groupBy(category, indicator).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(control, F.col(value))).alias("control"),
    )
    return pairs.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("double").alias("rows"),
        F.lit(float(len(df.columns))).alias("cols"),
        F.count_distinct(category).cast("double").alias("n_categories"),
        F.count_distinct(indicator).cast("double").alias("n_indicators"),
        F.sum("control").cast("double").alias("checksum"),
    )


def contract_drift(new: DataFrame, snapshot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that were added or removed since a snapshot.

    Both sides go through one aggregation, which treats NULL keys as equal and combines
    repeated keys map-side; two anti joins would shuffle each side twice.
    """
    sides = new.select(*keys, F.lit(1).alias("now"), F.lit(0).alias("then")).unionByName(
        snapshot.select(*keys, F.lit(0).alias("now"), F.lit(1).alias("then"))
    )
    seen = sides.groupBy(*keys).agg(F.max("now").alias("now"), F.max("then").alias("then"))
    return seen.filter(F.col("now") != F.col("then")).select(
        *keys, F.when(F.col("now") == 1, "added").otherwise("removed").alias("status")
    )


#: Buckets of keys in a digest; this many numbers are broadcast at most.
DIGEST_BUCKETS = 1 << 16


def _key_hash(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[part for k in keys for part in (F.col(k).isNull(), F.col(k))])


def differing_buckets(new: DataFrame, snapshot: DataFrame, keys: Sequence[str], buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """``bucket``: the hash buckets whose keys are not the same on both sides.

    Counts, sums and exclusive ors of two key hashes are taken bucket by bucket, those of the snapshot
    against those of the new side, so a task sends at most one row per bucket whatever it reads.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        return df.select(
            F.pmod(_key_hash(keys, 1), F.lit(buckets)).cast("int").alias("bucket"), F.lit(sign).alias("sign"),
            _key_hash(keys, 2).alias("one"), _key_hash(keys, 3).cast("decimal(20,0)").alias("other"))

    digests = side(new, 1).union(side(snapshot, -1)).groupBy("bucket").agg(
        F.sum("sign").alias("n"), F.bit_xor("one").alias("one"), F.sum(F.col("sign") * F.col("other")).alias("other"))
    return digests.filter((F.col("n") != 0) | (F.col("one") != 0) | (F.col("other") != 0)).select("bucket")


def snapshot_drift(new: DataFrame, snapshot: DataFrame, keys: Sequence[str], buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """``contract_drift`` for large sides that differ in few keys.

    Buckets of keys with equal digests are left where they are; only keys of the others are shuffled
    and compared. Both sides are read twice. The key columns must have the same types. A key repeated
    on one side only makes its bucket differ, which costs a comparison and changes no result.
    """
    kinds = [dict(df.select(*keys).dtypes) for df in (new, snapshot)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"key types differ: {kinds[0]} and {kinds[1]}")
    found = F.broadcast(differing_buckets(new, snapshot, keys, buckets).select(F.col("bucket").alias("_bucket")))

    def moved(df: DataFrame) -> DataFrame:
        bucket = F.pmod(_key_hash(keys, 1), F.lit(buckets)).cast("int")
        return df.select(*keys).withColumn("_key_bucket", bucket).join(
            found, F.col("_key_bucket") == F.col("_bucket"), "left_semi").select(*keys)

    return contract_drift(moved(new), moved(snapshot), keys)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row; empty for a valid panel."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of rows and of NULLs in each column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )


def assert_complete(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Fail when the table is empty or a column has NULLs. Runs one aggregation job."""
    counts = null_counts(df, columns).first().asDict()
    if counts.pop("n_rows") == 0:
        raise ValueError("no rows remain after cleaning")
    holes = [name.removeprefix("null_") for name, n in counts.items() if n]
    if holes:
        raise ValueError(f"missing values remain in {', '.join(holes)}")
    return df
