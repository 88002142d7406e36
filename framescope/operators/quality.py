"""Data quality: duplicates, type conformance, invalid values and the exception report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import is_missing, percent, short_key, strip
from ..functions.guards import by_name, quoted, require_columns
from .distribution import top_values, value_counts

# List lengths, section names (in report order) and severities.
TOP_INVALID = 5
TOP_BREAKDOWN = 6
DUPLICATES, TYPES, VALUES = "Duplicate Rows", "Wrong Data Types", "Inconsistent Values"
MALFORMED = "Malformed Rows"
ISSUE, WARNING = "issue", "warning"


@dataclass(frozen=True)
class Expectations:
    """What a table should look like.

    ``keys`` identify a row; ``types`` gives the expected type of columns; ``keywords``
    gives fragments that make a value invalid; ``not_blank`` lists text columns in which
    white space alone is wrong; ``domains`` gives allowed values; ``ids`` lists identifier
    columns that must not be stored as numbers with a decimal part.
    """

    keys: Sequence[str] = ()
    types: Mapping[str, str] = field(default_factory=dict)
    keywords: Mapping[str, Sequence[str]] = field(default_factory=dict)
    not_blank: Sequence[str] = ()
    domains: Mapping[str, Sequence[str]] = field(default_factory=dict)
    ids: Sequence[str] = ()


def has_keyword(value: Column, keywords: Sequence[str]) -> Column:
    """Whether the text contains a keyword, ignoring case; plain text, no patterns. NULL is false."""
    lowered = F.lower(value.cast("string"))
    hits = [lowered.contains(keyword.lower()) for keyword in keywords]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def is_blank(value: Column) -> Column:
    """Whether the text is there but only white space."""
    return F.coalesce(strip(value) == F.lit(""), F.lit(False))


def outside(value: Column, allowed: Sequence) -> Column:
    """Whether the value is there but not an allowed one."""
    return F.coalesce(~value.isin(*allowed), F.lit(False))


def is_float_id(value: Column, dtype: T.DataType) -> Column:
    """Whether an identifier was stored as a number with a decimal part."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNotNull() & ~F.isnan(value)
    if isinstance(dtype, T.StringType):
        return F.coalesce(value.rlike(r"^[0-9]+\.0$"), F.lit(False))
    return F.lit(False)


def does_not_convert(df: DataFrame, name: str, expected: str) -> Column:
    """Whether the value is there but cannot be read as the expected type.

    Where Spark has no cast between two types, the value's text is read.
    """
    value = by_name(df, name)
    try:
        df.select(value.try_cast(expected))
        converted = value.try_cast(expected)
    except AnalysisException:
        converted = value.cast("string").try_cast(expected)
    return value.isNotNull() & converted.isNull()


def same_type(stored: T.DataType, expected: T.DataType) -> bool:
    """Whether two types differ in their notation only: times with and without zone, texts of any length."""
    texts, times = (T.StringType, T.CharType, T.VarcharType), (T.TimestampType, T.TimestampNTZType)
    return stored == expected or any(isinstance(stored, k) and isinstance(expected, k) for k in (texts, times))


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(n, rows, pct)``: rows beyond the first of their key; NULL keys equal one another."""
    require_columns(df, keys)
    short = [short_key(by_name(df, key), df.schema[key].dataType).alias(f"_k{i}") for i, key in enumerate(keys)]
    per_key = df.groupBy(*short).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
    ).withColumn("pct", percent(F.col("n"), F.col("rows")))


def duplicate_finding(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(column, n, pct, severity)``: empty when nothing is duplicated."""
    return (
        duplicate_rows(df, keys)
        .where(F.col("n") > 0)
        .select(
            F.lit(", ".join(keys)).alias("column"), "n", "pct", F.lit(ISSUE).alias("severity")
        )
    )


def _tally(df: DataFrame, conditions: Sequence[tuple[dict[str, str], Column]]) -> DataFrame:
    """One row per condition with its labels, ``n`` and ``rows``; one scan for all."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(condition).alias(f"c{i}") for i, (_, condition) in enumerate(conditions)],
    )
    entries = [
        F.struct(
            *[F.lit(text).alias(name) for name, text in labels.items()],
            F.col(f"c{i}").alias("n"),
            F.col("rows"),
        )
        for i, (labels, _) in enumerate(conditions)
    ]
    return counted.select(F.inline(F.array(*entries))).withColumn(
        "pct", percent(F.col("n"), F.col("rows"))
    )


def type_conformance(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """``(column, stored_type, expected_type, n, rows, pct)``: values that do not convert."""
    require_columns(df, expected)
    stored = dict(df.dtypes)
    return _tally(
        df,
        [
            (
                {"column": name, "stored_type": stored[name], "expected_type": wanted},
                does_not_convert(df, name, wanted),
            )
            for name, wanted in expected.items()
        ],
    )


def invalid_values(df: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(column, n, rows, pct)``: values that contain a keyword, for all columns in one scan."""
    require_columns(df, keywords)
    return _tally(df, [({"column": c}, has_keyword(by_name(df, c), words)) for c, words in keywords.items()])


def top_invalid(
    df: DataFrame, column: str, keywords: Sequence[str], k: int = TOP_INVALID
) -> DataFrame:
    """``(value, n)``: the most frequent invalid values, spelled as in the data."""
    require_columns(df, [column])
    return (
        df.where(has_keyword(by_name(df, column), keywords))
        .groupBy(by_name(df, column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value"))
        .limit(k)
    )


def blank_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n, rows, pct)``: texts of white space only."""
    require_columns(df, columns)
    return _tally(df, [({"column": c}, is_blank(by_name(df, c))) for c in columns])


def domain_violations(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """``(value, n, pct)``: one row per value that is not allowed; missing is ignored.

    The list stays a table, as it may be long.
    """
    counts = value_counts(df, column)
    # Tested on the count, so that the shuffle is the one that the total uses.
    unexpected = F.when(outside(F.col("value"), allowed), F.col("n"))
    return counts.where(unexpected > 0)


def category_breakdown(df: DataFrame, column: str, k: int = TOP_BREAKDOWN) -> DataFrame:
    """``(value, n, pct)``: the most frequent of all values, allowed or not."""
    return top_values(df, column, k)


def float_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n, rows, pct)``: identifiers stored as numbers with a decimal part."""
    require_columns(df, columns)
    return _tally(
        df, [({"column": c}, is_float_id(by_name(df, c), df.schema[c].dataType)) for c in columns]
    )


def _findings(df: DataFrame, expected: Expectations) -> DataFrame:
    """Every rule with its count, whether it is an exception (``found``), and the rows."""
    stored = dict(df.dtypes)
    rules: list[tuple[dict[str, str], Column]] = []

    def rule(section: str, column: str, finding: str, note: str, condition: Column) -> None:
        labels = {"section": section, "column": column, "finding": finding, "severity": WARNING, "note": note}
        rules.append((labels, condition))

    for name, wanted in expected.types.items():
        if not same_type(df.schema[name].dataType, T.DataType.fromDDL(wanted)):
            note = f"stored as {stored[name]}, expected {wanted}"
            rule(TYPES, name, "wrong type", note, does_not_convert(df, name, wanted))
    for name, words in expected.keywords.items():
        rule(VALUES, name, "invalid values", "contains a listed keyword", has_keyword(by_name(df, name), words))
    for name in expected.not_blank:
        rule(VALUES, name, "blank strings", "white space instead of a missing value", is_blank(by_name(df, name)))
    for name, allowed in expected.domains.items():
        note = "allowed: " + ", ".join(str(a) for a in allowed)
        rule(VALUES, name, "unexpected values", note, outside(by_name(df, name), allowed))
    for name in expected.ids:
        decimal = is_float_id(by_name(df, name), df.schema[name].dataType)
        rule(VALUES, name, "ids stored as decimals", "cast to text before use", decimal)

    parts = []
    if expected.keys:
        parts.append(
            duplicate_rows(df, expected.keys).select(
                F.lit(DUPLICATES).alias("section"),
                F.lit(", ".join(expected.keys)).alias("column"),
                F.lit("duplicate rows").alias("finding"),
                F.lit(ISSUE).alias("severity"),
                F.lit("rows beyond the first of their key").alias("note"),
                "n",
                "rows",
                "pct",
            )
        )
    if rules or not parts:
        nothing = dict.fromkeys(("section", "column", "finding", "severity", "note"), "")
        parts.append(_tally(df, rules or [(nothing, F.lit(False))]))
    # A wrong type counts even when every value would convert.
    found = (F.col("n") > 0) | (F.col("section") == TYPES)
    return reduce(DataFrame.unionByName, parts).withColumn("found", found)


def malformed_finding(df: DataFrame, malformed: DataFrame) -> DataFrame:
    """The rows of a source that could not be read, as a finding of the exception report; empty if there are none."""
    whole = df.agg(F.count(F.lit(1))).scalar()
    counted = malformed.agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 0").select(
        F.lit(MALFORMED).alias("section"),
        F.lit("").alias("column"),
        F.lit("rows that could not be read").alias("finding"),
        "n",
        percent(F.col("n"), F.col("n") + whole).alias("pct"),
        F.lit(ISSUE).alias("severity"),
        F.lit("wrong number of fields, or values of another type").alias("note"),
    )


def exception_report(df: DataFrame, expected: Expectations, malformed: DataFrame | None = None) -> DataFrame:
    """``(section, column, finding, n, pct, severity, note)``: exceptions only.

    ``malformed`` are the rows that were put aside when the source was read; they are a
    section of their own.

    Two scans: one that groups by the keys, and one that counts every other condition. A
    wrong type is reported when the stored type is not the expected one; its count is the
    number of values that would not convert.
    """
    report = _findings(df, expected).where("found").select(
        "section", "column", "finding", "n", "pct", "severity", "note"
    )
    return report if malformed is None else report.unionByName(malformed_finding(df, malformed))


def exception_breakdown(df: DataFrame, expected: Expectations) -> DataFrame:
    """``(column, value, n)``: the values behind the invalid and unexpected ones.

    All columns are counted in one scan. Of a column with a keyword list the invalid values
    are listed, of one with a domain all values, the most frequent ones each.
    """
    sides = [
        (name, TOP_INVALID, F.when(has_keyword(by_name(df, name), words), by_name(df, name).cast("string")))
        for name, words in expected.keywords.items()
    ]
    sides += [(name, TOP_BREAKDOWN, by_name(df, name).cast("string")) for name in expected.domains]
    if not sides:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    entries = [
        F.struct(F.lit(i).alias("side"), F.lit(name).alias("column"), F.lit(k).alias("k"), value.alias("value"))
        for i, (name, k, value) in enumerate(sides)
    ]
    counts = (
        df.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("side", "column", "k", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Each task keeps its best rows per side before the ranking shuffle.
    order = Window.partitionBy("side").orderBy(F.desc("n"), F.asc("value"))
    best = counts.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= max(TOP_INVALID, TOP_BREAKDOWN)
    )
    return best.where(F.col("rank") <= F.col("k")).select("column", "value", "n")


def quality_rollup(df: DataFrame, expected: Expectations) -> DataFrame:
    """``(issues, warnings, rows, columns)`` over the exception report, from the same scans."""
    found = F.col("found")
    return _findings(df, expected).agg(
        F.count_if(found & (F.col("severity") == ISSUE)).alias("issues"),
        F.count_if(found & (F.col("severity") == WARNING)).alias("warnings"),
        F.max("rows").alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
    )


def missing_explained(df: DataFrame, target: str, flag: str) -> DataFrame:
    """``(flag, n_missing, rows, pct, explained)``: is ``target`` missing by the flag alone?

    It is when every group of the flag is missing wholly or not at all, and the groups differ.
    """
    require_columns(df, [target, flag])
    groups = df.groupBy(F.col(quoted(flag)).alias("flag")).agg(
        F.count_if(is_missing(F.col(quoted(target)), df.schema[target].dataType)).alias("n_missing"), F.count(F.lit(1)).alias("rows")
    )
    full, none = F.col("n_missing") == F.col("rows"), F.col("n_missing") == 0
    explained = groups.agg(F.every(full | none) & F.some(full) & F.some(none)).scalar()
    return groups.select(
        "flag",
        "n_missing",
        "rows",
        percent(F.col("n_missing"), F.col("rows")).alias("pct"),
        F.coalesce(explained, F.lit(False)).alias("explained"),
    )
