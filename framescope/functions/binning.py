"""Histogram bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bins of a linear histogram, and edges (one more than bins) of a logarithmic one.
LINEAR_BINS = 30
LOG_EDGES = 30

# Fixed value: the scale is logarithmic when the range of the numbers exceeds this ratio.
LOG_RATIO = 50


def wants_log_scale(lowest: Column, highest: Column) -> Column:
    """Whether positive numbers spread so far that a logarithmic scale suits them."""
    return highest / F.greatest(lowest, F.lit(1.0)) > F.lit(float(LOG_RATIO))


def linear_range(lowest: Column, highest: Column) -> tuple[Column, Column]:
    """Outer edges: the data range, widened by a half on both sides when it is one point."""
    half = F.when(lowest == highest, F.lit(0.5)).otherwise(F.lit(0.0))
    return lowest - half, highest + half


def log_range(lowest: Column, highest: Column) -> tuple[Column, Column]:
    """Outer exponents: whole decades, at least one."""
    start = F.floor(F.log10(lowest)).cast("double")
    stop = F.ceil(F.log10(highest)).cast("double")
    return start, F.greatest(stop, start + 1)


def linear_bin(x: Column, start: Column, stop: Column, bins: int) -> Column:
    """Bin number from 0; the last bin is closed. The estimate is corrected at the edges."""
    step = (stop - start) / bins
    guess = F.least(F.floor((x - start) / (stop - start) * bins), F.lit(bins - 1))
    return (
        guess
        - (x < start + guess * step).cast("bigint")
        + ((guess < bins - 1) & (x >= start + (guess + 1) * step)).cast("bigint")
    ).cast("int")


def log_bin(x: Column, start: Column, stop: Column, bins: int) -> Column:
    """Bin number from 0 on a scale of exponents ``start`` to ``stop``; the last bin is closed."""
    return F.least(
        F.floor((F.log10(x) - start) / (stop - start) * bins), F.lit(bins - 1)
    ).cast("int")


def linear_edge(index: Column, start: Column, stop: Column, bins: int) -> Column:
    """Left edge of bin ``index``."""
    return F.when(index == bins, stop).otherwise(start + index * ((stop - start) / bins))


def log_edge(index: Column, start: Column, stop: Column, bins: int) -> Column:
    """Left edge of bin ``index`` on the scale of exponents."""
    return F.pow(F.lit(10.0), start + (stop - start) * index / bins)
