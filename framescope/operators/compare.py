"""Comparison of groups: metric by group, composition, lift and headline counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import percent, positive_of
from ..functions.guards import quoted, require_columns
from ..functions.sizing import total_of
from .distribution import group_stats


def metric_by_group(
    df: DataFrame, metric: str, group: str, groups: Sequence[str] | None = None
) -> DataFrame:
    """Mean, p25, p75, p90 and count of the positives, rows and share of the table, per group.

    ``groups`` limits the listing; the share stays a share of all rows.
    """
    stats = group_stats(df, metric, group)
    return stats.where(F.col("group").isin(*groups)) if groups else stats


def metric_means_by_group(
    df: DataFrame, metrics: Sequence[str], group: str, groups: Sequence[str] | None = None
) -> DataFrame:
    """``(group, mean_<metric>…, rows, pct)``: means over the positives of each metric."""
    require_columns(df, [*metrics, group])
    grouped = df.groupBy(F.col(quoted(group)).alias("group")).agg(
        *[F.coalesce(F.avg(positive_of(df, m)), F.lit(0.0)).alias(f"mean_{m}") for m in metrics],
        F.count(F.lit(1)).alias("rows"),
    )
    shared = grouped.withColumn("pct", percent(F.col("rows"), total_of(grouped, "rows")))
    if not groups:
        return shared
    # Testing a count keeps the filter above the aggregation, whose shuffle the total reuses.
    listed = F.when(F.col("group").isin(*groups), F.col("rows"))
    return shared.where(listed > 0)


def composition(
    df: DataFrame,
    group: str,
    part: str,
    parts: Sequence[str],
    groups: Sequence[str] | None = None,
    metric: str | None = None,
) -> DataFrame:
    """``(group, part, part_position, n, pct)``: shares of the parts inside each group.

    Every listed part appears in every group, with 0 where it does not occur. Rows without
    a part do not count in the denominator; parts that are not listed do. With a ``metric``,
    ``metric_mean`` (over its positives) and ``group_rows`` stand beside, from the same scan.
    """
    require_columns(df, [group, part, *([metric] if metric else [])])
    source = df.where(F.col(quoted(group)).isin(*groups)) if groups else df
    beside = ["metric_mean", "group_rows"] if metric else []
    extra = [
        F.coalesce(F.avg(positive_of(df, metric)), F.lit(0.0)).alias("metric_mean"),
        F.count(F.lit(1)).alias("group_rows"),
    ] if metric else []
    counted = source.groupBy(F.col(quoted(group)).alias("group")).agg(
        F.count(F.col(quoted(part))).alias("_all"),
        *[F.count_if(F.col(quoted(part)) == F.lit(p)).alias(f"p{i}") for i, p in enumerate(parts)],
        *extra,
    )
    entries = [
        F.struct(
            F.lit(p).alias("part"), F.lit(i).alias("part_position"), F.col(f"p{i}").alias("n")
        )
        for i, p in enumerate(parts)
    ]
    return counted.select("group", "_all", *beside, F.inline(F.array(*entries))).select(
        "group",
        "part",
        "part_position",
        "n",
        F.coalesce(percent(F.col("n"), F.col("_all")), F.lit(0.0)).alias("pct"),
        *beside,
    )


def composition_bounds(composed: DataFrame) -> DataFrame:
    """Add ``lower`` and ``upper``: the layers of a bar that adds up to 100."""
    # A group has as many rows as parts were listed.
    below = (
        Window.partitionBy("group")
        .orderBy("part_position")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upper = F.sum("pct").over(below)
    return composed.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("pct"))


def trait_means(
    df: DataFrame,
    traits: Mapping[str, str],
    metric: str,
    limit_to: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``(trait, group, mean, n)``: positives of the metric for all traits, in one scan.

    ``traits`` maps a trait name to its column; ``limit_to`` names the groups of a trait
    that count (all of them if the trait is not named). A row without a group drops out.
    """
    require_columns(df, [*traits.values(), metric])
    limit_to = limit_to or {}

    def entry(trait: str, column: str) -> Column:
        group = F.col(quoted(column)).cast("string")
        if trait in limit_to:
            group = F.when(group.isin(*limit_to[trait]), group)
        return F.struct(F.lit(trait).alias("trait"), group.alias("group"))

    long = df.select(
        positive_of(df, metric).alias("_v"),
        F.inline(F.array(*[entry(t, c) for t, c in traits.items()])),
    )
    return (
        long.where(F.col("group").isNotNull())
        .groupBy("trait", "group")
        .agg(F.coalesce(F.avg("_v"), F.lit(0.0)).alias("mean"), F.count("_v").alias("n"))
    )


def trait_lift(
    df: DataFrame,
    traits: Mapping[str, str],
    metric: str,
    limit_to: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``(trait, low_mean, high_mean, lift)``: highest over lowest group mean.

    The lift is 1 when the lowest mean is 0.
    """
    low, high = F.col("low_mean"), F.col("high_mean")
    return (
        trait_means(df, traits, metric, limit_to)
        .groupBy("trait")
        .agg(F.min("mean").alias("low_mean"), F.max("mean").alias("high_mean"))
        .withColumn("lift", F.when(low > 0, F.try_divide(high, low)).otherwise(F.lit(1.0)))
    )


def headline(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``(measure, n, pct)``: all rows, and the rows that meet each condition, in one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(condition).alias(f"c{i}") for i, condition in enumerate(conditions.values())],
    )
    entries = [F.struct(F.lit("rows").alias("measure"), F.col("_all").alias("n"), F.col("_all").alias("all"))]
    entries += [
        F.struct(F.lit(name).alias("measure"), F.col(f"c{i}").alias("n"), F.col("_all").alias("all"))
        for i, name in enumerate(conditions)
    ]
    return counted.select(F.inline(F.array(*entries))).select(
        "measure", "n", percent(F.col("n"), F.col("all")).alias("pct")
    )
