from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from framescope.functions import sizing
from framescope.functions.wordlists import LANGUAGE_LABELS, METRIC_RENAMES
from framescope.operators import clean, profile

NAN = float("nan")


def one(df):
    return [tuple(r) for r in df.collect()]


def test_missing_counts_null_nan_and_empty_text(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, "", NAN), (3, None, None), (4, " ", 0.0), (5, "NA", 2.0)],
        "k int, s string, x double",
    )
    got = {r["column"]: (r["n_missing"], r["pct"], r["severity"]) for r in profile.missing_report(df).collect()}
    assert got == {"k": (0, 0.0, "Clean"), "s": (2, 40.0, "Critical"), "x": (2, 40.0, "Critical")}
    assert [r["column"] for r in profile.missing_columns(df).collect()] == ["s", "x"]
    assert one(profile.missing_summary(df)) == [(2, 3)]


def test_empty_table_has_no_percentage(spark):
    df = spark.createDataFrame([], "k int, s string")
    assert [(r["pct"], r["severity"]) for r in profile.missing_report(df).collect()] == [(None, None)] * 2
    assert one(profile.shape(df)) == [(0, 2)]


def test_severity_limits(spark):
    df = spark.createDataFrame([(0.0,), (4.999,), (5.0,), (19.999,), (20.0,)], "p double")
    assert [r[0] for r in df.select(profile.severity(F.col("p"))).collect()] == [
        "Clean", "Low", "Moderate", "Moderate", "Critical",
    ]


def test_schema_listing_and_distribution(spark):
    df = spark.createDataFrame([], "b string, a bigint, c string")
    assert one(profile.schema_listing(df)) == [(0, "b", "string"), (1, "a", "bigint"), (2, "c", "string")]
    assert one(profile.dtype_distribution(df)) == [("string", 2), ("bigint", 1)]


def test_flags(spark):
    df = spark.createDataFrame(
        [("True",), ("true",), (" YES ",), ("1",), ("1.0",), ("0",), ("no",), (None,)], "f string"
    )
    assert [r[0] for r in clean.normalise_flags(df, ["f", "absent"]).collect()] == [
        True, True, True, True, False, False, False, False,
    ]
    numbers = spark.createDataFrame([(1, True, 1.0), (0, False, 0.0)], "i int, b boolean, d double")
    assert one(clean.normalise_flags(numbers, ["i", "b", "d"])) == [(True, True, False), (False, False, False)]


def test_times(spark):
    df = spark.createDataFrame(
        [
            ("2025-01-02T03:04:05Z",),
            ("2025-01-02 10:00:00+08:00",),
            ("2025-01-02",),
            ("Sun Sep 21 10:00:00 +0000 2025",),
            ("Sun Sep 21 10:00:00 +0800 2025",),
            ("rubbish",),
            ("12:30",),
            (None,),
        ],
        "t string",
    )
    assert [r[0] for r in clean.parse_times(df, ["t"]).collect()] == [
        dt.datetime(2025, 1, 2, 3, 4, 5),
        dt.datetime(2025, 1, 2, 2),
        dt.datetime(2025, 1, 2),
        dt.datetime(2025, 9, 21, 10),
        dt.datetime(2025, 9, 21, 2),
        None,
        None,
        None,
    ]
    odd = spark.createDataFrame([("02/01/2025 03:04",)], "t string")
    assert one(clean.parse_times(odd, ["t"], ["dd/MM/yyyy HH:mm"])) == [(dt.datetime(2025, 1, 2, 3, 4),)]


def test_ids(spark):
    df = spark.createDataFrame([(972890161400492.0,), (1.0,), (NAN,), (None,)], "i double")
    assert [r[0] for r in clean.ids_to_text(df, ["i"]).collect()] == ["972890161400492", "1", None, None]
    text = spark.createDataFrame([("12.0",), ("007",), ("nan",), ("<NA>",), (None,)], "i string")
    assert [r[0] for r in clean.ids_to_text(text, ["i"]).collect()] == ["12", "007", None, None, None]


def test_rename_coerce_relabel_recode(spark):
    df = spark.createDataFrame([("5", "tl"), ("x", "xx"), ("nan", None)], "view_count string, lang string")
    renamed = clean.rename_known(df, METRIC_RENAMES)
    assert renamed.columns == ["viewCount", "lang"]
    assert [r[0] for r in clean.coerce_numbers(renamed, ["viewCount"]).collect()] == [5.0, None, None]
    assert [r[1] for r in clean.relabel(df, "lang", LANGUAGE_LABELS).collect()] == ["Filipino (tl)", "xx", None]
    assert [r[1] for r in clean.recode(df, "lang", ["xx"]).collect()] == ["tl", "Unknown", None]
    with pytest.raises(ValueError, match="nope"):
        clean.coerce_numbers(df, ["nope"])


def test_categories_labels_and_filters(spark):
    df = spark.createDataFrame([(" a ", 1.0), ("  ", NAN), (None, -1.0), ("b", 0.0)], "c string, x double")
    assert [r[0] for r in clean.standardise_categories(df, ["c"]).collect()] == ["a", "Unknown", "Unknown", "b"]
    assert one(clean.positive_only(df, "x")) == [(" a ", 1.0)]
    assert clean.drop_missing(df, ["c", "x"]).count() == 2
    assert one(clean.in_groups(df, "c", ["b", "z"])) == [("b", 0.0)]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r["l"] for r in clean.label_flag(flags, "f", "yes", "no", "l").collect()] == ["yes", "no", None]


def test_first_per_key_keeps_the_first_and_one_null_key(spark):
    rows = [(None, 2, "b"), (None, 1, "a"), ("k", 5, "x"), ("k", 3, "y"), ("k", 4, "z"), ("u", 1, "q")]
    df = spark.createDataFrame(rows, "key string, at int, v string")
    wanted = {(None, 1, "a"), ("k", 3, "y"), ("u", 1, "q")}
    for partitions in (1, 3):
        assert set(one(clean.first_per_key(df.repartition(partitions), ["key"], ["at"]))) == wanted
    assert clean.first_per_key(df, ["key"], ["at"]).columns == df.columns


@pytest.mark.parametrize("limit, hot_rows", [(500_000, None), (1, None), (1, 3)])
def test_relabel_by_a_table(spark, monkeypatch, limit, hot_rows):
    monkeypatch.setattr(sizing, "MAX_KEYED_ROWS", limit)
    values = ["hot"] * 10 + ["none"] * 8 + ["a", "b", "c", None, ""]
    df = spark.createDataFrame(list(enumerate(values)), "_value int, v string").repartition(3)
    table = spark.createDataFrame([("hot", "HOT"), ("a", "z"), ("a", "A"), ("b", None), (None, "never"), ("x", "X"), ("", "blank")], "from string, to string")
    wanted = {"hot": "HOT", "a": "A", "": "blank"}
    got = clean.relabel(df.withColumnRenamed("_value", "i"), "v", table, hot_rows)
    assert got.columns == ["i", "v"]
    assert {r["i"]: r["v"] for r in got.collect()} == {i: wanted.get(v, v) for i, v in enumerate(values)}


def test_ids_of_many_digits(spark):
    df = spark.createDataFrame([(1e19,), (1e20,), (9.3e18,), (1.5,), (2.0,), (1e39,), (-3.0,), (float("nan"),), (None,)], "id double")
    got = [r["id"] for r in clean.ids_to_text(df, ["id"]).collect()]
    assert got[:5] == ["1" + "0" * 19, "1" + "0" * 20, "93" + "0" * 17, "1.5", "2"] and got[6:] == ["-3", None, None]


def test_numbers_are_coerced_by_type(spark):
    df = spark.sql("select 1 i, cast('NaN' as double) d, cast(1.5 as float) f, cast(2.5 as decimal(5,2)) c, true b, '1d' s, ' 7 ' t, 'x' u, cast(null as int) n")
    got = clean.coerce_numbers(df, df.columns)
    assert {t for _, t in got.dtypes} == {"double"}
    assert tuple(got.collect()[0]) == (1.0, None, 1.5, 2.5, 1.0, None, 7.0, None, None)
    plan = got.select("i", "f")._jdf.queryExecution().executedPlan().toString()
    assert "rlike" not in plan.lower()
