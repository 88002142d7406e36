"""Counts, shares, top-k lists, number summaries and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binning as bins
from ..functions.cleaning import number_of, percent, positive_of
from ..functions.guards import quoted, require_columns
from ..functions.quantiles import summarise

# Sizes of the report lists.
TOP_CATEGORIES = 5
TOP_WITH_OTHERS = 20
OTHERS = "Others"


def _count_rows(df: DataFrame, column: str) -> DataFrame:
    """``(value, _rows)`` with the NULL group; the one shuffle that the counts below share."""
    require_columns(df, [column])
    return df.groupBy(F.col(quoted(column)).alias("value")).agg(F.count(F.lit(1)).alias("_rows"))


def _known(counted: DataFrame) -> DataFrame:
    """Drop the NULL group *after* the count.

    Testing the count instead of the key keeps the filter above the aggregation, so this
    branch and the total over all rows reuse one shuffle of one scan.
    """
    present = F.when(F.col("value").isNotNull(), F.col("_rows"))
    return counted.where(present > 0).select("value", F.col("_rows").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, pct)``; missing values are not listed but count in the denominator."""
    counted = _count_rows(df, column)
    total = counted.agg(F.sum("_rows")).scalar()
    return _known(counted).withColumn("pct", percent(F.col("n"), total))


def fixed_categories(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Counts in the given order; a category that does not occur has 0."""
    counted = _count_rows(df, column)
    total = counted.agg(F.sum("_rows")).scalar()
    wanted = counted.groupBy().agg(
        *[F.sum(F.when(F.col("value") == F.lit(c), F.col("_rows"))).alias(f"c{i}") for i, c in enumerate(categories)]
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("value"),
            F.coalesce(F.col(f"c{i}"), F.lit(0).cast("bigint")).alias("n"),
        )
        for i, c in enumerate(categories)
    ]
    return wanted.select(F.inline(F.array(*entries))).withColumn("pct", percent(F.col("n"), total))


def top_values(df: DataFrame, column: str, k: int = TOP_CATEGORIES) -> DataFrame:
    """The ``k`` most frequent values; equal counts are ordered by value."""
    return value_counts(df, column).orderBy(F.desc("n"), F.asc("value")).limit(k)


def top_values_with_others(
    df: DataFrame, column: str, k: int = TOP_WITH_OTHERS, others: str = OTHERS
) -> DataFrame:
    """``(value, n, pct, is_other)``: the top values that repeat, and one row for all else.

    The rest row is always there, even at 0. ``is_other`` tells it from a real value of
    the same name. Ascending order, as a report lists it.
    """
    counted = _count_rows(df, column)
    total = counted.agg(F.sum("_rows")).scalar()
    known = counted.agg(F.sum(F.when(F.col("value").isNotNull(), F.col("_rows")))).scalar()
    top = (
        _known(counted)
        .where(F.col("n") > 1)
        .orderBy(F.desc("n"), F.asc("value"))
        .limit(k)
        .withColumn("is_other", F.lit(False))
    )
    # At most k rows are gathered here.
    rest = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown")).select(
        F.lit(others).alias("value"),
        (F.coalesce(known, F.lit(0)) - F.col("shown")).alias("n"),
        F.lit(True).alias("is_other"),
    )
    return (
        top.unionByName(rest)
        .withColumn("pct", percent(F.col("n"), total))
        .select("value", "n", "pct", "is_other")
        .orderBy("n", F.desc("value"))
    )


def zero_inflation(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``(metric, n_numeric, n_zero, zero_pct)`` for many metrics in one scan."""
    require_columns(df, metrics)
    aggs = []
    for i, metric in enumerate(metrics):
        number = number_of(df, metric)
        aggs += [F.count(number).alias(f"n{i}"), F.count_if(number == 0).alias(f"z{i}")]
    entries = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.col(f"n{i}").alias("n_numeric"),
            F.col(f"z{i}").alias("n_zero"),
        )
        for i, metric in enumerate(metrics)
    ]
    return (
        df.agg(*aggs)
        .select(F.inline(F.array(*entries)))
        .withColumn("zero_pct", percent(F.col("n_zero"), F.col("n_numeric")))
    )


def _by_metric(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long form ``(metric, v)``: every metric of a row from the same scan."""
    require_columns(df, metrics)
    entries = [F.struct(F.lit(m).alias("metric"), number_of(df, m).alias("v")) for m in metrics]
    return df.select(F.inline(F.array(*entries)))


def status(n_numeric: Column, n_positive: Column) -> Column:
    """Whether there is anything to draw: ``no_data``, ``no_positive`` or ``ok``."""
    return F.when(n_numeric == 0, "no_data").when(n_positive == 0, "no_positive").otherwise("ok")


def metric_profile(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Zero share, and median, mean, quartiles and maximum of the positives, per metric."""
    number = F.col("v")
    summary = summarise(
        _by_metric(df, metrics),
        F.when(number > 0, number),
        ["metric"],
        (0.25, 0.5, 0.75),
        {"n_numeric": number.isNotNull(), "n_zero": number == 0},
    )
    # Every metric has its row, also where the table has none.
    spine = df.sparkSession.createDataFrame([(m,) for m in dict.fromkeys(metrics)], "metric string")
    summary = spine.join(summary, "metric", "left")
    summary = summary.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_numeric", "n_zero", "n")})
    return summary.select(
        "metric",
        "n_numeric",
        "n_zero",
        percent(F.col("n_zero"), F.col("n_numeric")).alias("zero_pct"),
        F.col("n").alias("n_positive"),
        F.col("quantiles")[1].alias("median"),
        "mean",
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[2].alias("q3"),
        F.col("highest").alias("max"),
        bins.wants_log_scale(F.col("lowest"), F.col("highest")).alias("log_scale"),
        status(F.col("n_numeric"), F.col("n")).alias("status"),
    )


def metric_profile_approx(df: DataFrame, metrics: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """The quartiles of :func:`metric_profile` from sketches: one scan, small rank error."""
    x = F.when(F.col("v") > 0, F.col("v"))
    return (
        _by_metric(df, metrics)
        .groupBy("metric")
        .agg(
            F.count(x).alias("n_positive"),
            F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias("_q"),
            F.avg(x).alias("mean"),
            F.max(x).alias("max"),
        )
        .select(
            "metric",
            "n_positive",
            F.col("_q")[1].alias("median"),
            "mean",
            F.col("_q")[0].alias("q1"),
            F.col("_q")[2].alias("q3"),
            "max",
        )
    )


def group_stats(
    df: DataFrame, metric: str, group: str, probs: Sequence[float] = (0.25, 0.75, 0.9)
) -> DataFrame:
    """Mean, quantiles and count of the positives per group; all 0 where there is none.

    ``rows`` counts every row of the group and ``pct`` is its share of the table.
    """
    require_columns(df, [metric, group])
    summary = summarise(df, positive_of(df, metric), [group], probs)
    zero = F.lit(0.0)
    return summary.select(
        F.col(quoted(group)).alias("group"),
        F.coalesce("mean", zero).alias("mean"),
        *[
            F.coalesce(F.col("quantiles")[i], zero).alias(f"p{round(p * 100)}")
            for i, p in enumerate(probs)
        ],
        "n",
        "rows",
        percent(F.col("rows"), F.col("all_rows")).alias("pct"),
    )


def histogram(
    df: DataFrame,
    metrics: Sequence[str],
    scale: str = "auto",
    n_bins: int = bins.LINEAR_BINS,
    log_edges: int = bins.LOG_EDGES,
) -> DataFrame:
    """``(metric, scale, bin, left, right, n)`` over the positives, empty bins included.

    Two scans: one for the ranges, one for the counts. The ranges are one row, read as a
    scalar subquery, so nothing is joined. A metric without positives has no bins.
    """
    if scale not in ("auto", "linear", "log"):
        raise ValueError(f"unknown scale: {scale}")
    require_columns(df, metrics)
    names = [f"x{i}" for i in range(len(metrics))]
    numbers = df.select(*[positive_of(df, m).alias(x) for m, x in zip(metrics, names)])

    def bounds(x: str) -> Column:
        lo, hi = F.col(f"{x}_lo"), F.col(f"{x}_hi")
        use_log = bins.wants_log_scale(lo, hi) if scale == "auto" else F.lit(scale == "log")
        linear, log = bins.linear_range(lo, hi), bins.log_range(lo, hi)
        return F.struct(
            use_log.alias("use_log"),
            F.when(use_log, log[0]).otherwise(linear[0]).alias("start"),
            F.when(use_log, log[1]).otherwise(linear[1]).alias("stop"),
        ).alias(x)

    ranges = (
        numbers.agg(
            *[
                agg
                for x in names
                for agg in (F.min(x).alias(f"{x}_lo"), F.max(x).alias(f"{x}_hi"))
            ]
        )
        .select(F.struct(*[bounds(x) for x in names]))
        .scalar()
    )
    long = (
        numbers.withColumn("_r", ranges)
        .select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(m).alias("metric"),
                            F.col(x).alias("x"),
                            F.col(f"_r.{x}.use_log").alias("use_log"),
                            F.col(f"_r.{x}.start").alias("start"),
                            F.col(f"_r.{x}.stop").alias("stop"),
                        )
                        for m, x in zip(metrics, names)
                    ]
                )
            )
        )
        .where(F.col("x").isNotNull())
    )
    x, start, stop = F.col("x"), F.col("start"), F.col("stop")
    place = F.when(F.col("use_log"), bins.log_bin(x, start, stop, log_edges - 1)).otherwise(
        bins.linear_bin(x, start, stop, n_bins)
    )
    fixed = ["metric", "use_log", "start", "stop"]
    # Per metric no more entries than bins.
    packed = (
        long.groupBy(*fixed, place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*fixed)
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"))
    )
    last = F.when(F.col("use_log"), F.lit(log_edges - 2)).otherwise(F.lit(n_bins - 1))
    spread = packed.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))

    def edge(offset: int) -> Column:
        index = F.col("bin") + F.lit(offset)
        return F.when(
            F.col("use_log"), bins.log_edge(index, start, stop, log_edges - 1)
        ).otherwise(bins.linear_edge(index, start, stop, n_bins))

    return spread.select(
        "metric",
        F.when(F.col("use_log"), "log").otherwise("linear").alias("scale"),
        "bin",
        edge(0).alias("left"),
        edge(1).alias("right"),
        F.coalesce(F.try_element_at("_n", F.col("bin")), F.lit(0).cast("bigint")).alias("n"),
    )


def labelled_counts(df: DataFrame, flag: Column, labels: Mapping[bool, str]) -> DataFrame:
    """Counts of a boolean under two labels, false first; both always listed."""
    value = F.when(flag, labels[True]).when(~flag, labels[False])
    return fixed_categories(df.select(value.alias("label")), "label", [labels[False], labels[True]])
