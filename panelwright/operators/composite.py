"""Weighted composite index over a comparison panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright import presets
from panelwright.functions import band, clip_nonneg, finite_or_null
from panelwright.operators.concentration import concentration_indices
from panelwright.operators.shares import unpivot_markets
from panelwright.sources import written

COMPONENTS = {
    "component_control": "score_control",
    "component_innov": "score_innov",
    "component_dispute": "score_dispute",
    "component_shock": "shock",
    "component_stock": "stock_share",
    "component_growth": "growth_share",
}

BROADCAST_GROUPS = 20_000  # ranges of so many groups are sent to every task
SALTS = 32


def change_features(panel: DataFrame) -> DataFrame:
    """Positive change (0 when unknown), size of the change, current level."""
    change, fraction = finite_or_null("delta_abs"), finite_or_null("delta_frac")
    return panel.withColumns({
        "delta_pos": F.coalesce(clip_nonneg(change), F.lit(0.0)),
        "shock": F.coalesce(F.abs(change), F.abs(fraction)),
        "stock": finite_or_null("value_current"),
    })


def global_shares(df: DataFrame) -> DataFrame:
    """Shares of the grand totals; zero when the total is not positive or the part unknown."""
    totals = df.agg(F.struct(F.sum("stock").alias("stock"), F.sum("delta_pos").alias("growth")))

    def part(value: str, total: Column) -> Column:
        return F.when((total > 0) & F.col(value).isNotNull(), F.col(value) / total).otherwise(F.lit(0.0))

    return df.withColumn("totals", totals.scalar()).withColumns({
        "stock_share": part("stock", F.col("totals.stock")),
        "growth_share": part("delta_pos", F.col("totals.growth")),
    }).drop("totals")


def keyword_flags(
    df: DataFrame,
    dimensions: Sequence[presets.Dimension] = presets.DIMENSIONS,
    category: str = "category",
    indicator: str = "indicator",
) -> DataFrame:
    """A 0/1 column ``is_<name>`` per dimension, from category membership and a pattern."""
    def flag(d: presets.Dimension) -> Column:
        text = F.coalesce(F.lower(F.col(indicator)).rlike(d.pattern), F.lit(False))
        if not d.categories:
            return text.cast("int")
        member = F.coalesce(F.col(category).isin(*d.categories), F.lit(False))
        return ((member | text) if d.mode == "any" else (member & text)).cast("int")

    return df.withColumns({f"is_{d.name}": flag(d) for d in dimensions})


def severity(df: DataFrame) -> DataFrame:
    """First known of the absolute change, the current level and the relative change."""
    sizes = [F.abs(finite_or_null(c)) for c in ("delta_abs", "value_current", "delta_frac")]
    return df.withColumn("severity", F.coalesce(*sizes))


def dimension_scores(df: DataFrame, names: Sequence[str] = ("control", "innov", "dispute")) -> DataFrame:
    return df.withColumns({f"score_{n}": F.col(f"is_{n}") * F.col("severity") for n in names})


def safe_rescale(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = (), broadcast_groups: int = BROADCAST_GROUPS
) -> DataFrame:
    """Min-max rescale to [0, 1], one new column per entry of ``columns`` (new: source).

    A column without values or without range gives zero on every row; otherwise NULL stays
    NULL. All ranges come from one aggregation. Without ``by`` it is a scalar subquery. With it the
    ranges are written and counted: up to ``broadcast_groups`` of them go to every task and the rows
    stay where they are; more are joined with each group's rows spread over ``SALTS`` keys, so that a
    group of most rows is not one task.
    """
    source = {new: finite_or_null(old) for new, old in columns.items()}
    ranges = [
        F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias(new) for new, x in source.items()
    ]
    if by:
        # A struct key, so that rows with a NULL group find their range as well.
        key = F.struct(*[F.col(c) for c in by])
        facts = written(df.groupBy(key.alias("range_key")).agg(F.struct(*ranges).alias("ranges")), "ranges")
        rows = df.withColumn("range_key", key)
        if facts.count() <= broadcast_groups:
            ranged = rows.join(F.broadcast(facts), "range_key")
        else:
            salted = facts.withColumn("range_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
            ranged = rows.withColumn("range_salt", salt).join(salted, ["range_key", "range_salt"])
    else:
        ranged = df.withColumn("ranges", df.agg(F.struct(*ranges)).scalar())

    def scaled(new: str) -> Column:
        low, high = F.col(f"ranges.{new}.low"), F.col(f"ranges.{new}.high")
        flat = low.isNull() | (low == high)
        return F.when(flat, F.lit(0.0)).otherwise((source[new] - low) / (high - low))

    return ranged.select(*df.columns, *[scaled(new).alias(new) for new in columns])


def composite_index(
    df: DataFrame,
    weights: Mapping[str, float] = presets.WEIGHTS,
    stock_weight: float = presets.STOCK_WEIGHT,
    stock_cap: float = presets.STOCK_CAP,
) -> DataFrame:
    """Weighted sum of the components where a change is known, else a capped share of the level."""
    parts = [F.coalesce(F.col(f"component_{n}"), F.lit(0.0)) * w for n, w in weights.items()]
    dynamic = parts[0]
    for part in parts[1:]:
        dynamic = dynamic + part
    static = F.least(F.coalesce(F.col("component_stock"), F.lit(0.0)) * stock_weight, F.lit(stock_cap))
    has_delta = finite_or_null("delta_abs").isNotNull() | finite_or_null("delta_frac").isNotNull()
    return df.withColumn("has_delta", has_delta).withColumn(
        "composite", F.when(F.col("has_delta"), dynamic).otherwise(static)
    )


def weighted_sum(df: DataFrame, columns: Mapping[str, float], name: str) -> DataFrame:
    """Weighted sum that is NULL as soon as one component is (the older index)."""
    total = F.lit(0.0)
    for column, weight in columns.items():
        total = total + F.col(column) * weight
    return df.withColumn(name, total)


def typology(df: DataFrame, rules=presets.TYPOLOGY, rest: str = presets.TYPOLOGY_REST) -> DataFrame:
    """Label of the first rule whose components all reach their thresholds."""
    label = None
    for conditions, text in rules:
        test = F.lit(True)
        for name, edge in conditions:
            test = test & (F.col(f"component_{name}") >= edge)
        label = F.when(test, F.lit(text)) if label is None else label.when(test, F.lit(text))
    return df.withColumn("typology", label.otherwise(F.lit(rest)))


def priority(df: DataFrame) -> DataFrame:
    return df.withColumn("priority", band(F.col("composite"), presets.PRIORITY_BANDS, presets.PRIORITY_REST))


def composite_table(
    panel: DataFrame,
    dimensions: Sequence[presets.Dimension] = presets.DIMENSIONS,
    weights: Mapping[str, float] = presets.WEIGHTS,
) -> DataFrame:
    """All steps from a comparison panel to index, typology and priority."""
    scored = dimension_scores(severity(keyword_flags(global_shares(change_features(panel)), dimensions)))
    return priority(typology(composite_index(safe_rescale(scored, COMPONENTS), weights)))


def ranked_index_table(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rounded index and context. Order by ``idx`` descending and the keys when writing it."""
    return table.select(
        *keys, F.bround("composite", 3).alias("idx"), "typology", "delta_abs", "delta_frac"
    )


def summary_by_type(table: DataFrame) -> DataFrame:
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    return table.groupBy("typology", "priority").agg(
        F.count(F.lit(1)).alias("n"),
        total("stock").alias("sum_stock"),
        total("delta_abs").alias("sum_delta_net"),
        total("delta_pos").alias("sum_delta_pos"),
        F.avg("composite").alias("avg_idx"),
    )


def diagnostics(table: DataFrame) -> DataFrame:
    def missing(c: str) -> Column:
        return F.count_if(F.col(c).isNull())

    return table.agg(
        F.count(F.lit(1)).alias("n_indicators"),
        missing("composite").alias("n_na_idx"),
        missing("delta_abs").alias("n_na_delta"),
        missing("value_base").alias("n_na_base"),
        missing("value_current").alias("n_na_current"),
        F.coalesce(F.sum("delta_abs"), F.lit(0.0)).alias("sum_net"),
        F.coalesce(F.sum("delta_pos"), F.lit(0.0)).alias("sum_pos"),
    )


def top_dynamic(table: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` highest indices among indicators with a known change."""
    rows = table.filter("has_delta").orderBy(F.col("composite").desc(), *keys).limit(k)
    return ranked_index_table(rows, keys)


def _whole(column: str, steps: int) -> Column:
    return F.floor(F.coalesce(finite_or_null(column), F.lit(0.0)) * steps + 0.5).cast("bigint")


def _square_distance(point: Sequence[Column], centre: Sequence[int]) -> Column:
    return sum(((x - F.lit(c)) * (x - F.lit(c)) for x, c in zip(point, centre)), F.lit(0).cast("bigint"))


def _nearest(point: Sequence[Column], centres: Sequence[Sequence[int]]) -> Column:
    """Label 1..k of the nearest centre; a tie goes to the lower label."""
    return F.array_min(F.array(*[
        F.struct(_square_distance(point, c).alias("d"), F.lit(label).alias("label"))
        for label, c in enumerate(centres, 1)]))["label"]


def fit_clusters(
    df: DataFrame, columns: Sequence[str], k: int = 5, steps: int = 1_000_000, rounds: int = 50
) -> list[list[int]]:
    """At most ``k`` centres in whole numbers, 1/``steps`` each, by Lloyd rounds from farthest-first seeds.

    Everything is counted in whole numbers, so the centres depend neither on a random seed nor on how
    rows are partitioned, and SQL can repeat them. Rows become points (NULL is zero); equal points are
    one with a weight. The first seed is the point of smallest MD5, each further one the point farthest
    from the seeds so far, ties by MD5; fewer distinct points give fewer centres, no rows none. A centre
    becomes the mean of its points, rounded down, until no centre moves or ``rounds`` have run; a centre
    without points stays. Values may reach 1000 at the default ``steps``; a distance beyond 64 bits fails.
    Each seed and each round is one aggregation to at most ``k`` rows.
    """
    names = [f"x{place}" for place in range(len(columns))]
    point = [F.col(x) for x in names]
    points = written(
        df.select(*[_whole(c, steps).alias(x) for c, x in zip(columns, names)]).groupBy(*names).agg(
            F.count(F.lit(1)).alias("n")), "cluster-points")
    digest = F.md5(F.concat_ws(",", *point).cast("binary")).alias("digest")
    centres: list[list[int]] = []
    while len(centres) < k:
        apart = F.array_min(F.array(*[_square_distance(point, c) for c in centres])) if centres else F.lit(1)
        farthest = points.agg(F.min(F.struct((-apart).alias("d"), digest, *point)).alias("s")).first()["s"]
        if farthest is None or farthest["d"] == 0:
            break
        centres.append([farthest[x] for x in names])
    for _ in range(rounds if centres else 0):
        sums = [F.sum(F.col("n").cast("decimal(18,0)") * x.cast("decimal(18,0)")).alias(name)
                for x, name in zip(point, names)]
        moved = list(centres)
        for row in points.groupBy(_nearest(point, centres).alias("label")).agg(F.sum("n").alias("n"), *sums).collect():
            moved[row["label"] - 1] = [int(row[x]) // row["n"] for x in names]
        if moved == centres:
            break
        centres = moved
    return centres


def cluster_indicators(
    df: DataFrame, columns: Sequence[str], k: int = 5, steps: int = 1_000_000, rounds: int = 50
) -> DataFrame:
    """Labels 1..k over the components, NULL taken as zero, by the centres of ``fit_clusters``.

    Fitting runs jobs over the distinct points; ``df`` itself is read once for them and once for the
    labels. No rows give no rows.
    """
    centres = fit_clusters(df, columns, k, steps, rounds)
    label = _nearest([_whole(c, steps) for c in columns], centres) if centres else F.lit(None).cast("int")
    return df.withColumn("cluster", label)


def assign_clusters(
    df: DataFrame, centres: Sequence[Sequence[float]], columns: Sequence[str], cluster: str = "cluster"
) -> DataFrame:
    """Label 1..k of the nearest of the given centres, NULL taken as zero; a tie goes to the lower label."""
    near = [
        F.struct(
            sum((F.pow(F.coalesce(F.col(c), F.lit(0.0)) - F.lit(float(x)), 2) for c, x in zip(columns, centre)), F.lit(0.0)).alias("d"),
            F.lit(label).alias("label"))
        for label, centre in enumerate(centres, 1)
    ]
    return df.withColumn(cluster, F.array_min(F.array(*near))["label"])


def cluster_profiles(
    df: DataFrame, means: Mapping[str, str], cluster: str = "cluster"
) -> DataFrame:
    """Per cluster: size and the mean of each column (name: source), missing values left out."""
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_indicators"),
        *[F.avg(old).alias(new) for new, old in means.items()],
    )


def index_metrics(panel: DataFrame) -> DataFrame:
    """One row: counts and sums of growth, Gini and HHI of growth and of the current level.

    Both measures are ranked in one pass, as two markets.
    """
    names = ("growth_pos", "stock_current")
    rows = panel.select(
        "delta_abs",
        clip_nonneg(finite_or_null("delta_abs")).alias("growth_pos"),
        F.col("value_current").alias("stock_current"),
    )
    indices = concentration_indices(unpivot_markets(rows, [], names), ["market"], "capacity")
    each = [
        F.max(F.when(F.col("market") == name, F.col(index))).alias(f"{index}_{name}")
        for index in ("gini", "hhi") for name in names
    ]
    return rows.agg(
        F.count(F.lit(1)).cast("double").alias("n_indicators"),
        F.count_if(F.col("growth_pos") > 0).cast("double").alias("n_positive_growth"),
        F.coalesce(F.sum("growth_pos"), F.lit(0.0)).alias("sum_pos"),
        F.coalesce(F.sum("delta_abs"), F.lit(0.0)).alias("sum_net"),
    ).withColumn("indices", indices.agg(F.struct(*each)).scalar()).select(
        "n_indicators", "n_positive_growth", "sum_pos", "sum_net", "indices.*"
    )
