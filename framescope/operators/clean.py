"""Projections, casts, recodes and filters over whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as fx
from ..functions.guards import by_name, own_columns, quoted, quoted_all, require_columns
from ..functions.sizing import keyed_table, settle


def normalise_flags(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn mixed boolean/text columns into booleans; missing becomes false."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: fx.is_true(by_name(df, name)) for name in present})


def parse_times(df: DataFrame, columns: Iterable[str], formats: Sequence[str] = ()) -> DataFrame:
    """Turn time text into UTC ``timestamp_ntz``; failures become NULL."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns(
        {name: fx.parse_utc(by_name(df, name), df.schema[name].dataType, formats) for name in present}
    )


def ids_to_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn identifiers into text without a decimal part."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: fx.id_text(by_name(df, name), df.schema[name].dataType) for name in present})


def rename_known(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns of the dictionary that the table has."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def coerce_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn columns into doubles; what is not a number becomes NULL."""
    names = list(columns)
    require_columns(df, names)
    return df.withColumns({name: fx.number_of(df, name) for name in names})


# Rows of one value that one task should join, about.
MAX_VALUE_ROWS = 5_000_000


def relabel(
    df: DataFrame, column: str, labels: Mapping[str, str] | DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Replace values by a dictionary; others pass through and NULL stays NULL.

    A dictionary stands in the plan. A table of ``(value, label)`` is joined (of repeated values the least
    label counts): by broadcast if it is small; else the values with more than ``hot_rows`` rows (5 million unless given), found by
    a count, take their labels by broadcast and the others by a shuffle, so a hot value is in no task of its own.
    """
    require_columns(df, [column])
    if not isinstance(labels, DataFrame):
        return df.withColumn(column, fx.relabel(by_name(df, column), labels))
    value, label = [F.col(quoted(name)) for name in labels.columns[:2]]
    pairs = labels.where(value.isNotNull() & label.isNotNull()).groupBy(value.alias("_value")).agg(F.min(label).alias("_label"))
    known, small = keyed_table(pairs)

    def labelled(rows: DataFrame, table: DataFrame, broadcast: bool) -> DataFrame:
        joined = rows.join(F.broadcast(table) if broadcast else table, F.col(quoted(column)) == F.col("_value"), "left")
        named = F.coalesce(F.col("_label").cast(df.schema[column].dataType), F.col(quoted(column)))
        return joined.withColumn(column, named).select(*own_columns(df))

    if small:
        return labelled(df, known, True)
    limit = MAX_VALUE_ROWS if hot_rows is None else hot_rows
    counts = df.where(by_name(df, column).isNotNull()).groupBy(F.col(quoted(column)).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot, few = settle(counts.where(F.col("_n") > limit).select("_hot"))
    if few is None or not few:  # none, or (with a small limit) so many that none stands out
        return labelled(df, known, False)
    own = known.join(F.broadcast(hot), F.col("_value") == F.col("_hot"), "left_semi")
    same = F.col(quoted(column)) == F.col("_hot")
    cold = labelled(df.join(F.broadcast(hot), same, "left_anti"), known, False)
    return cold.unionByName(labelled(df.join(F.broadcast(hot), same, "left_semi"), own, True))


def label_flag(df: DataFrame, column: str, when_true: str, when_false: str, into: str) -> DataFrame:
    require_columns(df, [column])
    return df.withColumn(into, fx.flag_label(by_name(df, column), when_true, when_false))


def standardise_categories(df: DataFrame, columns: Iterable[str], unknown: str = fx.UNKNOWN) -> DataFrame:
    """Trim category text; missing and blank become ``unknown``."""
    names = list(columns)
    require_columns(df, names)
    return df.withColumns({name: fx.category_text(by_name(df, name), unknown) for name in names})


def recode(df: DataFrame, column: str, invalid: Iterable[str], label: str = fx.UNKNOWN) -> DataFrame:
    require_columns(df, [column])
    return df.withColumn(column, fx.recode(by_name(df, column), invalid, label))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the rows in which one of the columns is NULL or NaN."""
    require_columns(df, columns)
    return df.na.drop(subset=quoted_all(columns))


def positive_only(df: DataFrame, column: str) -> DataFrame:
    """Keep the rows whose number is above zero; the column itself is not changed."""
    require_columns(df, [column])
    return df.where(fx.positive_of(df, column).isNotNull())


def in_groups(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Keep the rows whose value is one of ``values``."""
    require_columns(df, [column])
    return df.where(by_name(df, column).isin(*list(values)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Remove duplicates by key; the first row by ``order`` stays. NULL keys equal one another.

    Uses the smallest row per key, which combines before the shuffle: a key that holds a
    third of the table sends one row per task, where a window would sort it in one task.
    The remaining columns break ties, so the result does not depend on the partitioning.
    """
    require_columns(df, [*keys, *order])
    rest = [name for name in df.columns if name not in keys and name not in order]
    carried = [name for name in order if name not in keys] + rest
    if not carried:
        return df.select(*quoted_all(keys)).distinct()
    maps = [name for name in carried if "map<" in df.schema[name].dataType.simpleString()]
    if maps:  # a map cannot be compared; its text breaks ties
        place = F.struct(*[by_name(df, name).cast("string").alias(name) if name in maps else by_name(df, name) for name in carried])
        row = F.min_by(F.struct(*quoted_all(carried)), place).alias("_row")
    else:
        row = F.min(F.struct(*quoted_all(carried))).alias("_row")
    kept = df.groupBy(*quoted_all(keys)).agg(row)
    return kept.select(
        *[F.col(quoted(name)) if name in keys else F.col("_row")[name].alias(name) for name in df.columns]
    )
