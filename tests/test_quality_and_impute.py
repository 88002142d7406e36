from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framescope.functions import sizing
from framescope.functions.wordlists import NON_PLACE_KEYWORDS
from framescope.operators import impute, quality

NAN = float("nan")


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (None, "Earth", "  ", "x1", 1.0, "5"), (None, "Manila t.co/abc", "bio", "en", None, "6"),
        ("a", "tXco", "", "tl", NAN, "seven"), ("a", "MANILA, earthward", None, "en", 4.0, None),
        ("a", None, "b", None, 5.0, "8"), ("b", "Earth", "c", "und", 6.0, "9.5"),
    ]
    return spark.createDataFrame(
        rows, "name string, place string, bio string, lang string, ref double, age string"
    ).repartition(3)


def test_duplicates_count_missing_keys_as_one(people):
    assert one(quality.duplicate_rows(people, ["name"])) == [(3, 6, 50.0)]
    assert one(quality.duplicate_finding(people, ["name"])) == [("name", 3, 50.0, "issue")]
    assert quality.duplicate_finding(people, ["name", "place", "bio"]).count() == 0
    long = people.withColumn("place", F.concat(F.repeat(F.lit("x"), 64), F.col("place")))
    assert one(quality.duplicate_rows(long, ["place"])) == [(1, 6, pytest.approx(100 / 6))]
    n, rows, _ = one(quality.duplicate_rows(people, ["lang"]))[0]
    assert n == rows - people.select("lang").distinct().count()


def test_keywords_are_plain_text_without_case(people):
    got = one(quality.invalid_values(people, {"place": NON_PLACE_KEYWORDS}))
    assert got == [("place", 4, 6, pytest.approx(66.6666667))]
    assert one(quality.top_invalid(people, "place", NON_PLACE_KEYWORDS)) == [
        ("Earth", 2), ("MANILA, earthward", 1), ("Manila t.co/abc", 1),
    ]


def test_blanks_domains_ids_and_types(people):
    assert one(quality.blank_strings(people, ["bio"]))[0][:2] == ("bio", 2)
    assert sorted(one(quality.domain_violations(people, "lang", ["tl", "en"]))) == [
        ("und", 1, pytest.approx(100 / 6)), ("x1", 1, pytest.approx(100 / 6)),
    ]
    assert one(quality.float_ids(people, ["ref", "age"])) == [
        ("ref", 4, 6, pytest.approx(400 / 6)), ("age", 0, 6, 0.0),
    ]
    assert one(quality.type_conformance(people, {"age": "int"}))[0][:4] == ("age", "string", "int", 2)


def test_report_leaves_out_what_is_in_order(people):
    expected = quality.Expectations(
        keys=["name"], types={"age": "int", "name": "string"}, keywords={"place": ["nowhere at all"]},
        not_blank=["bio"], domains={"lang": ["tl", "en", "und", "x1"]}, ids=["ref"],
    )
    report = quality.exception_report(people, expected)
    assert {(r["section"], r["column"], r["n"]) for r in report.collect()} == {
        ("Duplicate Rows", "name", 3), ("Wrong Data Types", "age", 2),
        ("Inconsistent Values", "bio", 2), ("Inconsistent Values", "ref", 4),
    }
    assert one(quality.quality_rollup(people, expected)) == [(1, 3, 6, 6)]
    fine = quality.Expectations(types={"name": "string"})
    assert quality.exception_report(people, fine).count() == 0
    assert one(quality.quality_rollup(people, fine)) == [(0, 0, 6, 6)]
    places = quality.Expectations(keywords={"place": ["earth"]}, domains={"lang": ["en"]})
    assert set(one(quality.exception_breakdown(people, places))) == {
        ("place", "Earth", 2), ("place", "MANILA, earthward", 1),
        ("lang", "en", 2), ("lang", "tl", 1), ("lang", "und", 1), ("lang", "x1", 1),
    }


def test_missing_is_explained_only_by_a_lockstep_flag(spark):
    df = spark.createDataFrame(
        [(None, False, 1), (None, False, 2), ("u", True, 1), ("v", True, 2)], "target string, flag boolean, other int"
    )
    assert {r["explained"] for r in quality.missing_explained(df, "target", "flag").collect()} == {True}
    assert {r["explained"] for r in quality.missing_explained(df, "target", "other").collect()} == {False}
    full = df.where("flag")
    assert {r["explained"] for r in quality.missing_explained(full, "target", "flag").collect()} == {False}


def test_rows_and_columns_are_deleted(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", 1.0), (3, "b", NAN), (4, "c", 2.0)], "k int, s string, x double")
    assert one(impute.drop_incomplete_rows(df)) == [(4, "c", 2.0)]
    assert impute.drop_sparse_columns(df, 30.0).columns == ["k", "s"]
    assert impute.drop_sparse_columns(df, 30.0, keep=["x"]).columns == ["k", "s", "x"]


def test_fixed_and_statistics(spark):
    df = spark.createDataFrame(
        [(1.0, 4, "b"), (NAN, None, "a"), (2.0, 4, ""), (None, 8, "a"), (6.0, None, "b")], "x double, i int, s string"
    )
    assert one(impute.fill_fixed(df, {"x": 0.0, "s": "?"}))[1] == (0.0, None, "a")
    got = one(impute.fill_statistic(df, {"x": "mean", "i": "mode", "s": "mode"}))
    assert got == [(1.0, 4, "b"), (3.0, 4, "a"), (2.0, 4, "a"), (3.0, 8, "a"), (6.0, 4, "b")]
    assert [r[0] for r in one(impute.fill_statistic(df, {"x": "median", "i": "median"}))] == [1.0, 2.0, 2.0, 2.0, 6.0]
    ints = spark.createDataFrame([(10,), (9,), (None,)], "i int")
    assert one(impute.fill_statistic(ints, {"i": "mode"}))[2] == (9,)  # a tie is decided by number, not text
    with pytest.raises(ValueError, match="magic"):
        impute.fill_statistic(df, {"x": "magic"})


@pytest.mark.parametrize("chunk, most", [("hour", 0), ("year", 0), (None, 5_000_000), (None, 100), (None, 3), (None, 0)])
def test_fills_in_order_equal_pandas(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(impute, "MAX_CHUNK_ROWS", most)
    rng = random.Random(5)
    start = dt.datetime(2025, 1, 1)
    rows = [
        (rng.choice(["hot", "hot", "hot", "a", None]), start + dt.timedelta(hours=rng.randrange(200)), i,
         None if rng.random() < 0.6 else float(i))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, i int, v double").repartition(5)
    pdf = pd.DataFrame(rows, columns=["k", "at", "i", "v"]).sort_values(["at", "i"])
    grouped = pdf.groupby("k", dropna=False)["v"]
    for fill, wanted in ((impute.fill_forward, grouped.ffill()), (impute.fill_backward, grouped.bfill())):
        got = fill(df, "v", ["k"], "at", ["i"], chunk=F.date_trunc(chunk, "at") if chunk else None)
        values = {r["i"]: r["v"] for r in got.collect()}
        assert values == {i: (None if pd.isna(v) else v) for i, v in zip(pdf["i"], wanted)}
        assert got.columns == df.columns


def test_fill_needs_a_key(spark):
    df = spark.createDataFrame([(1, 1, None)], "k int, at int, v int")
    with pytest.raises(ValueError, match="key"):
        impute.fill_forward(df, "v", [], "at")


@pytest.mark.parametrize("order", ["n", "name", "day", "at"])
def test_hot_keys_of_any_order_are_cut(spark, monkeypatch, order):
    """Also where all rows of the key have one day and one second."""
    rows = [(1, i, f"{i:03d}", dt.date(2025, 1, 1), dt.datetime(2025, 1, 1), i, float(i) if i % 7 == 0 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, n int, name string, day date, at timestamp_ntz, i int, v double").repartition(4)
    for rows_ in (5, 1_000):
        got = impute.fill_forward(df, "v", ["k"], order, ["i"], chunk_rows=rows_)
        assert {r["i"]: r["v"] for r in got.collect()} == {i: float(i - i % 7) for i in range(100)}
    seen = []
    over_chunks = impute._over_chunks
    monkeypatch.setattr(impute, "_over_chunks", lambda base, *rest: seen.append(base) or over_chunks(base, *rest))
    impute.fill_forward(df, "v", ["k"], order, ["i"], chunk_rows=5)
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 30


@pytest.mark.parametrize("chunk_rows", [None, 7])
def test_nearest_donors(spark, chunk_rows):
    rng = random.Random(9)
    rows = [
        (i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, NAN, *[float(n) for n in range(40)]]),
         rng.choice([None, None, "", "x", "y", "z"]))
        for i in range(300)
    ] + [(900, "alone", 1.0, None), (901, "b", 2.5, None)]
    df = spark.createDataFrame(rows, "i int, k string, at double, v string").repartition(5)
    donors = [(k, at, v) for _, k, at, v in rows if v and at is not None and at == at]

    def wanted(k, at, v):
        near = [(abs(at - d), value) for key, d, value in donors if key == k] if not v and at is not None and at == at else []
        return min(near)[1] if near else v

    got = impute.fill_from_nearest(df, "v", ["k"], "at", chunk_rows)
    assert got.columns == df.columns
    assert {r["i"]: r["v"] for r in got.collect()} == {i: wanted(k, at, v) for i, k, at, v in rows}


def test_nearest_donors_in_time(spark):
    rows = [(1, dt.date(2025, 1, 1), 5), (2, dt.date(2025, 1, 4), None), (3, dt.date(2025, 1, 6), 7), (4, dt.date(2025, 1, 11), None), (5, None, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, i int, day date, v int")
    assert {r["i"]: r["v"] for r in impute.fill_from_nearest(df, "v", ["k"], "day").collect()} == {1: 5, 2: 7, 3: 7, 4: 7, 5: None}
    none = df.where("false")
    assert impute.fill_from_nearest(none, "v", ["k"], "day").collect() == []
    assert {r["v"] for r in impute.fill_from_nearest_donor(df, "v", ["k"], "day", none).collect()} == {5, 7, None}
    with pytest.raises(ValueError, match="match key"):
        impute.fill_from_nearest(df, "v", [], "day")


def test_ties_of_donors_do_not_depend_on_partitions(spark):
    rows = [("a", 1, v) for v in (8.0, 6.0, 9.0, 7.0)] + [("a", 2, None)]
    for parts in (1, 2, 3, 4):
        df = spark.createDataFrame(rows, "g string, o int, v double").repartition(parts)
        assert {r["v"] for r in impute.fill_from_similar(df, "v", ["g"], "o").where("o = 2").collect()} == {6.0}


def test_means_of_whole_numbers_and_text_classes(spark):
    ints = spark.createDataFrame([(1,), (2,), (2,), (None,)], "i int")
    assert one(impute.fill_statistic(ints, {"i": "mean"}))[3][0] == pytest.approx(5 / 3)
    rows = [(float(i), ("low" if i < 10 else "high") if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, c string")
    got = {r["x"]: r["c"] for r in impute.fill_by_model(df, "c", ["x"], "classification").collect()}
    assert got[0.0] == "low" and got[16.0] == "high"


def test_white_space_types_and_keywords(spark):
    df = spark.createDataFrame([("\t",), ("\n\u00a0",), (" x\t",), (None,)], "s string")
    assert one(quality.blank_strings(df, ["s"]))[0][:2] == ("s", 2)
    assert one(df.select(quality.strip(df["s"])))[2] == ("x",)
    ids = spark.createDataFrame([(7,)], "n bigint")
    assert one(quality.type_conformance(ids, {"n": "date"}))[0][:4] == ("n", "bigint", "date", 1)
    times = spark.sql("select timestamp_ntz'2025-01-01 00:00:00' as at")
    assert quality.exception_report(times, quality.Expectations(types={"at": "timestamp"})).count() == 0
    names = spark.createDataFrame([("SRC1",), ("x",)], "s string")
    assert one(quality.invalid_values(names, {"s": ["SRC1"]}))[0][1] == 1


@pytest.mark.parametrize("limit", [10_000, 1])
def test_donors(spark, monkeypatch, limit):
    monkeypatch.setattr(sizing, "MAX_SMALL_ROWS", limit)
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", 7.0), (3, "a", 9.0), (4, None, 5.0), (5, None, NAN), (6, "c", None)],
        "id int, g string, v double",
    ).repartition(3)
    got = dict((r["id"], r["v"]) for r in impute.fill_from_similar(df, "v", ["g"], "id").collect())
    assert got == {1: 7.0, 2: 7.0, 3: 9.0, 4: 5.0, 5: 5.0, 6: None}
    donors = spark.createDataFrame([("c", 2, 1.5), ("c", 1, 2.5), ("a", 1, None)], "g string, o int, v double")
    cold = dict((r["id"], r["v"]) for r in impute.fill_from_donors(df, "v", ["g"], donors, "o").collect())
    assert cold[6] == 2.5 and cold[1] is None and cold[2] == 7.0


def test_models(spark):
    rows = [(float(i), 2.0 * i + 1 if i % 3 else None, int(i >= 10) if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame([*rows, (None, None, None)], "x double, y double, c int")
    got = {r["x"]: r["y"] for r in impute.fill_by_model(df, "y", ["x"]).collect()}
    assert got[9.0] == pytest.approx(19.0) and got[None] is None and len(got) == 21
    classes = {r["x"]: r["c"] for r in impute.fill_by_model(df, "c", ["x"], "classification").collect()}
    assert classes[0.0] == 0 and classes[16.0] == 1 and classes[None] is None
    with pytest.raises(ValueError, match="kind"):
        impute.fill_by_model(df, "y", ["x"], "guess")


def test_models_of_one_and_of_three_classes(spark):
    rows = [(float(x), float(y), f"{'abc'[x // 10]}" if (x + y) % 5 else None) for x in range(30) for y in range(3)] + [(1.0, NAN, None), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, c string")
    got = {(r["x"], r["y"]): r["c"] for r in impute.fill_by_model(df, "c", ["x", "y"], "classification").collect() if r["y"] == r["y"]}
    assert [got[float(x), 0.0] for x in (0, 5, 15, 25)] == ["a", "a", "b", "c"] and got[None, 1.0] is None
    alone = df.where("c is null or c = 'a'")
    assert {r["c"] for r in impute.fill_by_model(alone, "c", ["x", "y"], "classification").where("x is not null and not isnan(y)").collect()} == {"a"}
