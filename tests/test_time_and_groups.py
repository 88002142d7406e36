from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from framescope.operators import compare, temporal


def one(df):
    return [tuple(r) for r in df.collect()]


def day(d, h=0):
    return dt.datetime(2025, 3, d, h)


@pytest.fixture(scope="module")
def posts(spark):
    # 2 March 2025 is a Sunday, 3 March a Monday; 4 March has no rows.
    rows = [
        (day(2, 23), "tl"), (day(2, 1), "tl"), (day(2), "en"), (day(3), "tl"), (day(3), None),
        (day(3, 5), "fr"), (day(5), "en"), (day(5), "en"), (day(5), "und"), (None, "xx"), (None, "xx"),
        (None, "xx"), (None, "xx"), (None, "xx"),
    ]
    return spark.createDataFrame(rows, "at timestamp_ntz, lang string").repartition(3)


def test_volume_keeps_the_top_series_and_pools_the_rest(posts):
    got = set(one(temporal.volume(posts, "at", "lang")))
    assert got == {
        (day(2), "tl", 2, 2), (day(2), "en", 1, 1),
        (day(3), "tl", 2, 1), (day(3), "Other", 3, 2),
        (day(5), "en", 1, 2), (day(5), "Other", 3, 1),
    }


def test_weeks_start_on_monday(posts):
    weeks = dict(one(temporal.period_totals(posts, "at", "W")))
    assert weeks == {dt.datetime(2025, 2, 24): 3, day(3): 6}
    with pytest.raises(ValueError, match="alias"):
        temporal.period_totals(posts, "at", "fortnight")


def test_pivot_totals_equal_the_long_form(posts):
    wide = temporal.volume_pivot(posts, "at", "lang", labels={"tl": "Filipino (tl)"})
    # Both top series have three rows, so their labels decide the order.
    assert wide.columns == ["period", "Filipino (tl)", "en", "Other"]
    assert set(one(wide)) == {(day(2), 2, 1, 0), (day(3), 1, 0, 2), (day(5), 0, 2, 1)}


def test_peaks_break_ties_by_time(posts):
    assert one(temporal.peak_periods(posts, "at")) == [(day(2), 3), (day(3), 3), (day(5), 3)]


def test_layers_touch(posts):
    by_period = {}
    for r in temporal.stacked_bounds(posts, "at", "lang").orderBy("period", "series_rank").collect():
        assert r["lower"] == by_period.get(r["period"], 0)
        by_period[r["period"]] = r["upper"]
    assert by_period == {day(2): 3, day(3): 3, day(5): 3}


def test_volume_does_not_depend_on_partitions(posts):
    assert set(one(temporal.volume(posts.repartition(7), "at", "lang"))) == set(
        one(temporal.volume(posts.coalesce(1), "at", "lang"))
    )


@pytest.fixture(scope="module")
def engagement(spark):
    rows = [
        ("tl", True, 10.0, 0.0), ("tl", True, 30.0, 2.0), ("tl", False, 0.0, 4.0),
        ("en", False, 100.0, 0.0), ("en", None, None, 6.0), ("und", False, 5.0, 1.0), (None, True, 7.0, 1.0),
        ("zz", None, 0.0, -5.0),
    ]
    df = spark.createDataFrame(rows, "lang string, reply boolean, views double, shares double")
    label = F.when(F.col("reply"), "Reply").when(~F.col("reply"), "Original")
    return df.withColumn("kind", label).repartition(3)


def test_metric_by_group_counts_all_rows_but_averages_positives(engagement):
    got = {r["group"]: r for r in compare.metric_by_group(engagement, "views", "lang", ["tl", "en"]).collect()}
    assert set(got) == {"tl", "en"}
    assert (got["tl"]["mean"], got["tl"]["n"], got["tl"]["rows"], got["tl"]["pct"]) == (20.0, 2, 3, 37.5)
    assert (got["tl"]["p25"], got["tl"]["p75"], got["tl"]["p90"]) == (15.0, 25.0, 28.0)


def test_means_of_many_metrics(engagement):
    got = {r["group"]: tuple(r)[1:] for r in compare.metric_means_by_group(engagement, ["views", "shares"], "lang").collect()}
    assert got["tl"] == (20.0, 3.0, 3, 37.5)
    assert got["zz"] == (0.0, 0.0, 1, 12.5)
    assert got[None] == (7.0, 1.0, 1, 12.5)


def test_composition_adds_up_and_keeps_absent_parts(engagement):
    parts = ["Original", "Reply", "Quote"]
    got = compare.composition_bounds(
        compare.composition(engagement, "lang", "kind", parts, ["tl", "en"], metric="views")
    ).collect()
    rows = {(r["group"], r["part"]): r for r in got}
    assert round(rows["tl", "Reply"]["pct"], 6) == 66.666667 and rows["tl", "Quote"]["n"] == 0
    assert rows["en", "Original"]["pct"] == 100.0  # the row without a kind does not count
    assert {round(r["upper"], 9) for r in got if r["part"] == "Quote"} == {100.0}
    assert (rows["en", "Reply"]["metric_mean"], rows["en", "Reply"]["group_rows"]) == (100.0, 2)


def test_lift(engagement):
    traits = {"Language": "lang", "Kind": "kind", "Odd": "odd"}
    df = engagement.withColumn("odd", F.when(F.col("lang") == "zz", "none").otherwise("some"))
    got = {r["trait"]: (r["low_mean"], r["high_mean"], r["lift"]) for r in compare.trait_lift(df, traits, "views", {"Language": ["tl", "en"]}).collect()}
    assert got["Language"] == (20.0, 100.0, 5.0)
    assert got["Kind"] == (pytest.approx(47 / 3), 52.5, pytest.approx(52.5 / (47 / 3)))
    assert got["Odd"][0] == 0.0 and got["Odd"][2] == 1.0


def test_headline(engagement):
    got = {r["measure"]: (r["n"], r["pct"]) for r in compare.headline(engagement, {"replies": F.col("reply"), "tl": F.col("lang") == "tl"}).collect()}
    assert got == {"rows": (8, 100.0), "replies": (3, 37.5), "tl": (3, 37.5)}
    empty = compare.headline(engagement.where("false"), {"replies": F.col("reply")}).collect()
    assert {(r["n"], r["pct"]) for r in empty} == {(0, None)}
