from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framescope.functions import sizing
from framescope.functions.quantiles import cell_of, summarise
from framescope.operators import distribution as dist

NAN = float("nan")
PROBS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def one(df):
    return [tuple(r) for r in df.collect()]


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)


def check_groups(spark, groups):
    groups = {g: [None if v is None else float(v) for v in values] for g, values in groups.items()}
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r["g"]: r for r in summarise(df, F.col("x"), ["g"], PROBS).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        present = pd.Series([v for v in values if v is not None], dtype=float)
        row = got[g]
        assert (row["rows"], row["n"]) == (len(values), len(present))
        assert row["all_rows"] == len(rows)
        if len(present):
            np.testing.assert_allclose(row["quantiles"], present.quantile(list(PROBS)).to_numpy(), rtol=1e-12)
            np.testing.assert_allclose(row["mean"], present.mean(), rtol=1e-9, atol=1e-9)
            assert (row["lowest"], row["highest"]) == (present.min(), present.max())
        else:
            assert row["quantiles"] == [None] * len(PROBS)


def skewed_groups():
    rng = np.random.default_rng(7)
    return {
        "narrow": list(1.0 + rng.random(400) * 1e-6),
        "wide": list(10 ** rng.uniform(-3, 9, 300)),
        "signed": list(rng.normal(0, 5, 301)),
        "hot": [3.5] * 500 + list(rng.random(20)),
        "none": [None, None],
        "single": [2.25],
        None: [1.0, 2.0, 4.0, None],
    }


def test_quantiles_by_group(spark):
    check_groups(spark, skewed_groups())


def test_quantiles_by_group_with_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(sizing, "MAX_SMALL_ROWS", 2)
    check_groups(spark, skewed_groups())


def test_quantiles_of_a_whole_table(spark):
    values = list(np.random.default_rng(1).lognormal(3, 2, 999))
    row = summarise(frame(spark, values), F.col("x"), (), PROBS).collect()[0]
    np.testing.assert_allclose(row["quantiles"], pd.Series(values).quantile(list(PROBS)).to_numpy(), rtol=1e-12)
    empty = summarise(frame(spark, []), F.col("x"), (), PROBS).collect()[0]
    assert (empty["n"], empty["rows"], empty["quantiles"]) == (0, 0, [None] * 6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=True), min_size=2, max_size=60))
def test_cells_never_decrease(spark, values):
    got = frame(spark, values).select("x", cell_of(F.col("x")).alias("c")).orderBy("x").collect()
    cells = [r["c"] for r in got]
    assert cells == sorted(cells) and None not in cells


def test_profile_of_edge_metrics(spark):
    df = spark.createDataFrame(
        [(0.0, -1.0, 7.0, 1.0, None, NAN), (0.0, -2.0, None, 50.0, None, 3.0)],
        "zeros double, negative double, single double, ratio double, empty double, nan double",
    )
    got = {r["metric"]: r for r in dist.metric_profile(df, df.columns).collect()}
    assert [got[m]["status"] for m in df.columns] == [
        "no_positive", "no_positive", "ok", "ok", "no_data", "ok",
    ]
    assert (got["zeros"]["n_zero"], got["zeros"]["zero_pct"]) == (2, 100.0)
    assert got["single"]["median"] == 7.0 and got["single"]["n_numeric"] == 1
    assert got["ratio"]["log_scale"] is False  # a ratio of exactly 50 is not above it
    assert got["nan"]["n_numeric"] == 1 and got["nan"]["max"] == 3.0
    assert got["empty"]["zero_pct"] is None


def test_approximate_profile_is_close(spark):
    df = frame(spark, range(1, 1001))
    row = dist.metric_profile_approx(df, ["x"]).collect()[0]
    assert abs(row["median"] - 500.5) <= 1 and row["n_positive"] == 1000


def reference_bins(values, log):
    positive = np.array([v for v in values if v > 0])
    if not log:
        return np.histogram(positive, bins=30)
    lo, hi = int(np.floor(np.log10(positive.min()))), int(np.ceil(np.log10(positive.max())))
    return np.histogram(positive, bins=np.logspace(lo, max(hi, lo + 1), 30))


@pytest.mark.parametrize(
    "values, log",
    [
        ([0.0, -3.0, *np.round(np.arange(1, 40) * 0.1, 1)], False),
        (list(range(1, 41)), False),
        ([5.0, 5.0], False),
        ([1, 10, 100, 1000, 99, 9, 31, 0], True),
        ([2.0, 3.0, 200.0], True),
    ],
)
def test_histogram_equals_numpy(spark, values, log):
    counts, edges = reference_bins(values, log)
    got = dist.histogram(frame(spark, [float(v) for v in values]), ["x"]).orderBy("bin").collect()
    assert {r["scale"] for r in got} == {"log" if log else "linear"}
    assert [r["n"] for r in got] == list(counts)
    np.testing.assert_allclose([r["left"] for r in got] + [got[-1]["right"]], edges, rtol=1e-12)


def test_histogram_of_many_metrics_adds_up(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in zip(rng.integers(0, 9, 200), 10 ** rng.uniform(0, 6, 200))]
    df = spark.createDataFrame([*rows, (None, -1.0)], "a double, b double")
    totals = {r["metric"]: r["n"] for r in dist.histogram(df, ["a", "b"]).groupBy("metric").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"a": sum(a > 0 for a, _ in rows), "b": 200}
    assert dist.histogram(df.select((F.col("b") * 0).alias("z")), ["z"]).count() == 0


def test_counts_and_shares(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert set(one(dist.value_counts(df, "c"))) == {("a", 2, 50.0), ("b", 1, 25.0)}
    assert one(dist.fixed_categories(df, "c", ["b", "z", "a"]).orderBy("position")) == [
        (0, "b", 1, 25.0), (1, "z", 0, 0.0), (2, "a", 2, 50.0),
    ]


def test_ties_are_ordered_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "ddccbba"], "c string")
    assert [r["value"] for r in dist.top_values(df, "c", 2).collect()] == ["b", "c"]


def test_others_take_the_rest_and_differ_from_a_real_value(spark):
    values = ["Others"] * 3 + ["a"] * 2 + ["b"] * 2 + ["c", "d", None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = one(dist.top_values_with_others(df, "c", 2))
    assert sorted((v, n, o) for v, n, _, o in got) == [("Others", 3, False), ("Others", 4, True), ("a", 2, False)]
    assert sum(n for _, n, _, _ in got) == 9
    singles = spark.createDataFrame([("x",), ("y",)], "c string")
    assert one(dist.top_values_with_others(singles, "c")) == [("Others", 2, 100.0, True)]
    repeated = spark.createDataFrame([("x",), ("x",)], "c string")
    assert one(dist.top_values_with_others(repeated, "c")) == [("Others", 0, 0.0, True), ("x", 2, 100.0, False)]


def test_group_without_positives_is_all_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", -1.0), ("b", 4.0), (None, 2.0)], "g string, v double")
    got = {r["group"]: tuple(r)[1:] for r in dist.group_stats(df, "v", "g").collect()}
    assert got["a"] == (0.0, 0.0, 0.0, 0.0, 0, 2, 50.0)
    assert got["b"] == (4.0, 4.0, 4.0, 4.0, 1, 1, 25.0)
    assert got[None] == (2.0, 2.0, 2.0, 2.0, 1, 1, 25.0)
