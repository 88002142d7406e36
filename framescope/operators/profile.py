"""Shape, schema and missing values of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.cleaning import is_missing, percent
from ..functions.guards import by_name, require_columns

# Upper limits (not included) of the severity classes, in percent.
LOW_BELOW = 5
MODERATE_BELOW = 20


def shape(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``(rows, columns)``; with ``counted`` (see :func:`counting`) the table is not read."""
    if counted is not None:
        return counted.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("columns"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns")
    )


def schema_listing(df: DataFrame) -> DataFrame:
    """``(ordinal, column, dtype)`` in table order; reads only the schema."""
    listing = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(listing, "ordinal int, column string, dtype string")


def dtype_distribution(df: DataFrame) -> DataFrame:
    """``(dtype, n_columns)``, most frequent first."""
    return (
        schema_listing(df)
        .groupBy("dtype")
        .agg(F.count(F.lit(1)).alias("n_columns"))
        .orderBy(F.desc("n_columns"), "dtype")
    )


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, column, n_missing, rows)``: NULL, NaN and empty text, in one scan."""
    names = list(columns or df.columns)
    require_columns(df, names)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count_if(is_missing(by_name(df, name), df.schema[name].dataType)).alias(f"m{i}")
            for i, name in enumerate(names)
        ],
    )
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("column"),
            F.col(f"m{i}").alias("n_missing"),
            F.col("rows"),
        )
        for i, name in enumerate(names)
    ]
    return counted.select(F.inline(F.array(*entries)))


def counting(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df``, counting its rows and missing values while something else is done with it.

    The counts come from the tasks of the first action on the result, such as the write of a copy, so
    they cost no scan. Use it where that action has no shuffle above it: then each partition counts once,
    also when a task is run again.
    """
    observation = Observation()
    counts = [F.count_if(is_missing(by_name(df, f.name), f.dataType)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *counts), observation


def observed_counts(df: DataFrame, observation: Observation) -> DataFrame:
    """What :func:`missing_counts` gives, from an action that has run; one row per column."""
    seen = observation.get
    rows = [(i, name, seen[f"m{i}"], seen["rows"]) for i, name in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, n_missing bigint, rows bigint")


def severity(pct: Column) -> Column:
    """Class of a missing percentage; NULL stays NULL."""
    return (
        F.when(pct == 0, "Clean")
        .when(pct < LOW_BELOW, "Low")
        .when(pct < MODERATE_BELOW, "Moderate")
        .when(pct.isNotNull(), "Critical")
    )


def missing_report(
    df: DataFrame, columns: Sequence[str] | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Missing counts with ``pct`` and ``severity``, one row per column."""
    counts = missing_counts(df, columns) if counted is None else counted
    shares = counts.withColumn("pct", percent(F.col("n_missing"), F.col("rows")))
    return shares.withColumn("severity", severity(F.col("pct")))


def missing_columns(
    df: DataFrame, columns: Sequence[str] | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """Only the columns with missing values, by ascending share."""
    return (
        missing_report(df, columns, counted)
        .where(F.col("n_missing") > 0)
        .orderBy("pct", "n_missing", "column")
    )


def missing_summary(
    df: DataFrame, columns: Sequence[str] | None = None, counted: DataFrame | None = None
) -> DataFrame:
    """``(columns_with_missing, columns)``."""
    counts = missing_counts(df, columns) if counted is None else counted
    return counts.agg(
        F.count_if(F.col("n_missing") > 0).alias("columns_with_missing"),
        F.count(F.lit(1)).alias("columns"),
    )
