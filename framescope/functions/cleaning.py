"""Column expressions that normalise, recode and test values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .guards import by_name

# The spellings of "true" that are accepted, compared in lower case.
TRUE_TOKENS = ("true", "1", "yes")

# The label of a missing category.
UNKNOWN = "Unknown"

# "Sun Sep 21 10:00:00 +0000 2025": the weekday name is cut off because the parser rejects it.
WEEKDAY_STYLE = "MMM dd HH:mm:ss Z yyyy"


# White space at either end, with the separators beyond ASCII and the information separators.
EDGES = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def strip(value: Column) -> Column:
    """Text without white space (of any kind) at either end."""
    return F.regexp_replace(value.cast("string"), EDGES, "")


def is_true(value: Column) -> Column:
    """Text, number or boolean to boolean; a missing value is false."""
    return F.coalesce(F.lower(strip(value)).isin(*TRUE_TOKENS), F.lit(False))


def parse_utc(value: Column, dtype: T.DataType | None = None, formats: Sequence[str] = ()) -> Column:
    """Time text to a UTC ``timestamp_ntz``; what cannot be parsed becomes NULL.

    ISO text (with or without offset) and the weekday style above are always tried;
    ``formats`` adds more patterns. The text is parsed to an instant first, so an offset
    counts, and only then loses its zone. Needs a session in UTC.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return value
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return value.cast("timestamp_ntz")
    text = strip(value)
    # Spark also reads a bare time or a bare year; neither is a date here.
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))
    weekday = F.try_to_timestamp(F.regexp_replace(text, r"^\S+ ", ""), F.lit(WEEKDAY_STYLE))
    extra = [F.try_to_timestamp(text, F.lit(pattern)) for pattern in formats]
    return F.coalesce(iso, weekday, *extra).cast("timestamp_ntz")


def id_text(value: Column, dtype: T.DataType) -> Column:
    """Identifier to text without a decimal part; NULL, NaN and "nan" texts become NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # A fraction, or a number beyond 38 digits, stays as it is written: other ids must not merge.
        whole = F.when(value.cast("double") % F.lit(1.0) == 0, value.try_cast("decimal(38,0)"))
        return F.when(~F.isnan(value), F.coalesce(whole.cast("string"), value.cast("string")))
    text = value.cast("string")
    whole = F.regexp_replace(text, r"^([0-9]+)\.0+$", "$1")
    return F.when(~text.isin("nan", "<NA>"), whole)


def to_number(value: Column, dtype: T.DataType | None = None) -> Column:
    """Value to double; what is not a number (NaN included) becomes NULL.

    With its type, a column of numbers is cast alone; only text has to be looked at.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nullif(value.cast("double"), F.lit(float("nan")))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    # Spark would also read the type suffixes of "1d" and "2f".
    suffixed = value.cast("string").rlike(r"[0-9.][dDfF]\s*$")
    number = F.when(~suffixed, value.try_cast("double"))
    return F.when(~F.isnan(number), number)


def number_of(df: DataFrame, name: str) -> Column:
    """A column of a frame as a double, by its type."""
    return to_number(by_name(df, name), df.schema[name].dataType)


def positive(value: Column, dtype: T.DataType | None = None) -> Column:
    """The number where it is above zero, else NULL."""
    number = to_number(value, dtype)
    return F.when(number > 0, number)


def positive_of(df: DataFrame, name: str) -> Column:
    """A column of a frame where it is a number above zero."""
    return positive(by_name(df, name), df.schema[name].dataType)


def relabel(value: Column, labels: Mapping[str, str]) -> Column:
    """Replace values by the dictionary; others pass through and NULL stays NULL."""
    if not labels:
        return value
    entries = [F.lit(item) for pair in labels.items() for item in pair]
    return F.when(value.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*entries), value), value))


def flag_label(flag: Column, when_true: str, when_false: str) -> Column:
    """Boolean to one of two labels; NULL stays NULL."""
    return F.when(flag, F.lit(when_true)).when(~flag, F.lit(when_false))


def category_text(value: Column, unknown: str = UNKNOWN) -> Column:
    """Trimmed text; missing and blank become ``unknown``."""
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(unknown))


def recode(value: Column, invalid: Iterable[str], label: str = UNKNOWN) -> Column:
    """Replace each value of a list by one label."""
    return F.when(value.isin(*list(invalid)), F.lit(label)).otherwise(value)


def is_missing(value: Column, dtype: T.DataType) -> Column:
    """NULL, NaN in a floating column, or empty text."""
    missing = value.isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return missing | F.isnan(value)
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return missing | (value == F.lit(""))
    return missing


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; NULL when ``whole`` is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def short_key(value: Column, dtype: T.DataType) -> Column:
    """A grouping key of at most 64 characters that is equal exactly where ``value`` is.

    A long text is replaced by its SHA-256 digest, so that grouping by whole documents
    shuffles digests and not the documents. A shorter text stays as it is and, being
    shorter than a digest, cannot be taken for one.
    """
    if not isinstance(dtype, T.StringType):
        return value
    return F.when(F.length(value) >= 64, F.sha2(value, 256)).otherwise(value)
