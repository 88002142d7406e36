"""Volume over time: period by series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import relabel
from ..functions.guards import by_name, require_columns
from ..functions.periods import period_start

# Series kept by default, the name of the rest, and the number of peaks.
TOP_SERIES = 2
OTHER = "Other"
PEAKS = 3

# Most series that can be asked for: they are broadcast, and may be columns.
MAX_TOP = 10_000


def period(ts: Column, freq: str = "D", bins: bool = False) -> Column:
    """Start of the period that ``ts`` lies in; for aliases see :mod:`..functions.periods`."""
    return period_start(ts, freq, bins)


def _top(top: int) -> int:
    if not 0 <= top <= MAX_TOP:
        raise ValueError(f"the number of top series must be from 0 to {MAX_TOP}: {top}")
    return top


def _counted(
    df: DataFrame, ts: str, series: str, freq: str, labels: Mapping[str, str] | None, bins: bool = False
) -> DataFrame:
    """``(period, label, n)``: the one aggregation that everything here starts from."""
    require_columns(df, [ts, series])
    label = relabel(by_name(df, series), labels or {})
    return (
        df.where(by_name(df, ts).isNotNull())
        .groupBy(period(by_name(df, ts), freq, bins).alias("period"), label.alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _top_labels(counted: DataFrame, top: int) -> DataFrame:
    """``(series, series_rank)``: at most ``top`` rows, most frequent first."""
    # As in value counts, the NULL label is dropped by its count, so the scan is shared.
    known = F.sum(F.when(F.col("label").isNotNull(), F.col("n")))
    best = (
        counted.groupBy("label")
        .agg(known.alias("total"))
        .where(F.col("total") > 0)
        .orderBy(F.desc("total"), F.asc("label"))
        .limit(_top(top))
    )
    # One task ranks at most `top` rows.
    order = Window.orderBy(F.desc("total"), F.asc("label"))
    return best.select(
        F.col("label").alias("series"), F.row_number().over(order).alias("series_rank")
    )


def volume(
    df: DataFrame,
    ts: str,
    series: str,
    freq: str = "D",
    top: int = TOP_SERIES,
    other: str = OTHER,
    labels: Mapping[str, str] | None = None,
    bins: bool = False,
) -> DataFrame:
    """``(period, series, series_rank, n)`` for the top series; the rest is ``other``.

    ``bins`` makes an alias of several units, such as ``15min``, bins of that width.

    Rows without a time drop out; rows without a series go to ``other``, which is ranked
    after the top series (a real series of that name keeps its own rank).
    """
    counted = _counted(df, ts, series, freq, labels, bins)
    # The right side has at most `top` rows, so it may be broadcast.
    ranked = F.broadcast(_top_labels(counted, top))
    name = F.coalesce(F.col("series"), F.lit(other))
    return (
        counted.join(ranked, F.col("label") == F.col("series"), "left")
        .groupBy("period", name.alias("series"))
        .agg(
            F.coalesce(F.min("series_rank"), F.lit(top + 1)).alias("series_rank"),
            F.sum("n").alias("n"),
        )
    )


def volume_pivot(
    df: DataFrame,
    ts: str,
    series: str,
    freq: str = "D",
    top: int = TOP_SERIES,
    other: str = OTHER,
    labels: Mapping[str, str] | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Wide form: one column per series, top series first, zero where there is nothing.

    Without ``names`` a first job finds them (at most ``top + 1``), as column names must be
    known before the table is built. Only periods that occur are listed.
    """
    long = volume(df, ts, series, freq, top, other, labels)
    if names is None:
        found = long.groupBy("series").agg(F.min("series_rank").alias("r"), F.sum("n").alias("n"))
        best = found.where(F.col("n") > 0).orderBy("r", "series").limit(top + 1)
        names = [row["series"] for row in best.collect()]
    if not names:
        return long.select("period").distinct()
    if "period" in names:
        raise ValueError("a series is named 'period', as the key column is; rename it by labels")
    return long.groupBy("period").pivot("series", list(names)).agg(F.sum("n")).na.fill(0, list(names))


def period_totals(df: DataFrame, ts: str, freq: str = "D", bins: bool = False) -> DataFrame:
    """``(period, n)``."""
    require_columns(df, [ts])
    return (
        df.where(by_name(df, ts).isNotNull())
        .groupBy(period(by_name(df, ts), freq, bins).alias("period"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def peak_periods(df: DataFrame, ts: str, freq: str = "D", k: int = PEAKS) -> DataFrame:
    """The ``k`` periods with most rows; equal totals are ordered by time."""
    return period_totals(df, ts, freq).orderBy(F.desc("n"), F.asc("period")).limit(k)


def stacked_bounds(
    df: DataFrame,
    ts: str,
    series: str,
    freq: str = "D",
    top: int = TOP_SERIES,
    other: str = OTHER,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(period, series, series_rank, n, lower, upper)``: the layers of a stacked chart."""
    long = volume(df, ts, series, freq, top, other, labels)
    # A period has at most top + 1 series.
    below = (
        Window.partitionBy("period")
        .orderBy("series_rank", "series")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upper = F.sum("n").over(below)
    return long.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("n"))
