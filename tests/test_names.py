"""Every operator on columns whose names hold dots, blanks and quotes gives what it gives on plain names."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from framescope.operators import clean, compare, distribution, impute, profile, quality, temporal, textstats

ODD = {"i": "row.id", "g": "my group", "p": "a`b", "x": "x.y.z", "v": "v.1", "t": "created.at", "s": "the text", "f": "is.true"}


@pytest.fixture(scope="module")
def plain(spark):
    start = dt.datetime(2025, 1, 1)
    rows = [
        (i, "ab"[i % 2] if i % 5 else None, "pq"[i % 3 == 0], float(i % 7) if i % 4 else None, None if i % 3 else float(i),
         start + dt.timedelta(hours=7 * i), f"Some words {i} #tag{i % 3} @77 here", i % 2 == 0)
        for i in range(40)
    ]
    return spark.createDataFrame(rows, "i int, g string, p string, x double, v double, t timestamp_ntz, s string, f boolean").repartition(3)


def n(name, odd):
    return ODD[name] if odd else name


CALLS = {
    "shape": lambda d, o: profile.shape(d),
    "missing_summary": lambda d, o: profile.missing_summary(d),
    "normalise_flags": lambda d, o: clean.normalise_flags(d, [n("f", o)]),
    "parse_times": lambda d, o: clean.parse_times(d, [n("t", o)]),
    "ids_to_text": lambda d, o: clean.ids_to_text(d, [n("x", o)]),
    "rename_known": lambda d, o: clean.rename_known(d, {n("x", o): "other"}),
    "coerce_numbers": lambda d, o: clean.coerce_numbers(d, [n("x", o), n("i", o)]),
    "relabel": lambda d, o: clean.relabel(d, n("g", o), {"a": "A"}),
    "relabel_by_table": lambda d, o: clean.relabel(d, n("g", o), d.sparkSession.createDataFrame([("a", "A")], "`k.k` string, `l.l` string")),
    "label_flag": lambda d, o: clean.label_flag(d, n("f", o), "yes", "no", "made"),
    "standardise": lambda d, o: clean.standardise_categories(d, [n("g", o)]),
    "recode": lambda d, o: clean.recode(d, n("g", o), ["a"]),
    "drop_missing": lambda d, o: clean.drop_missing(d, [n("g", o), n("v", o)]),
    "positive_only": lambda d, o: clean.positive_only(d, n("x", o)),
    "in_groups": lambda d, o: clean.in_groups(d, n("g", o), ["a"]),
    "first_per_key": lambda d, o: clean.first_per_key(d, [n("g", o)], [n("i", o)]),
    "duplicates": lambda d, o: quality.duplicate_rows(d, [n("g", o), n("p", o)]),
    "top_invalid": lambda d, o: quality.top_invalid(d, n("s", o), ["words"]),
    "domain": lambda d, o: quality.domain_violations(d, n("g", o), ["a"]),
    "rollup": lambda d, o: quality.quality_rollup(d, quality.Expectations([n("g", o)], {n("s", o): "int"}, {n("s", o): ["tag1"]}, [n("p", o)], {n("p", o): ["p"]}, [n("x", o)])),
    "breakdown": lambda d, o: quality.exception_breakdown(d, quality.Expectations(keywords={n("s", o): ["tag1"]}, domains={n("p", o): ["p"]})).drop("column"),
    "explained": lambda d, o: quality.missing_explained(d, n("v", o), n("f", o)),
    "value_counts": lambda d, o: distribution.value_counts(d, n("g", o)),
    "fixed": lambda d, o: distribution.fixed_categories(d, n("g", o), ["a", "z"]),
    "top": lambda d, o: distribution.top_values_with_others(d, n("g", o), 1),
    "zeros": lambda d, o: distribution.zero_inflation(d, [n("x", o)]).drop("metric"),
    "profile": lambda d, o: distribution.metric_profile(d, [n("x", o), n("v", o)]).drop("metric"),
    "approx": lambda d, o: distribution.metric_profile_approx(d, [n("x", o)]).drop("metric"),
    "group_stats": lambda d, o: distribution.group_stats(d, n("x", o), n("g", o)),
    "histogram": lambda d, o: distribution.histogram(d, [n("x", o), n("v", o)]).drop("metric"),
    "metric_by_group": lambda d, o: compare.metric_by_group(d, n("x", o), n("g", o)),
    "means": lambda d, o: compare.metric_means_by_group(d, [n("x", o)], n("g", o)).toDF("group", "mean", "rows", "pct"),
    "composition": lambda d, o: compare.composition(d, n("g", o), n("p", o), ["p", "q"], metric=n("x", o)),
    "traits": lambda d, o: compare.trait_means(d, {"one": n("g", o), "two": n("p", o)}, n("x", o)),
    "volume": lambda d, o: temporal.volume(d, n("t", o), n("g", o), "W"),
    "pivot": lambda d, o: temporal.volume_pivot(d, n("t", o), n("g", o), "M"),
    "totals": lambda d, o: temporal.peak_periods(d, n("t", o)),
    "bounds": lambda d, o: temporal.stacked_bounds(d, n("t", o), n("g", o)),
    "tokens": lambda d, o: textstats.clean_tokens(d, n("s", o)),
    "keywords": lambda d, o: textstats.keywords(d, n("s", o)),
    "hashtags": lambda d, o: textstats.hashtags(d, n("s", o)),
    "bigrams": lambda d, o: textstats.bigrams(d, n("s", o)),
    "mentions": lambda d, o: textstats.numeric_mentions(d, n("s", o)),
    "kpis": lambda d, o: textstats.text_kpis(d, n("s", o)),
    "terms": lambda d, o: textstats.top_terms(d, n("s", o)),
    "sketches": lambda d, o: textstats.unique_hashtags(textstats.hashtag_sketches(d, n("t", o), n("s", o)), ["period"]),
    "frequent": lambda d, o: textstats.frequent_terms(d, n("s", o), k=1).drop("term"),
    "incomplete": lambda d, o: impute.drop_incomplete_rows(d, [n("g", o), n("x", o)]),
    "sparse": lambda d, o: impute.drop_sparse_columns(d, 50.0),
    "fixed_fill": lambda d, o: impute.fill_fixed(d, {n("g", o): "none", n("v", o): 0.5}),
    "statistic": lambda d, o: impute.fill_statistic(d, {n("g", o): "mode", n("v", o): "median", n("x", o): "mean"}),
    "forward": lambda d, o: impute.fill_forward(d, n("v", o), [n("p", o)], n("t", o), [n("i", o)]),
    "backward_cut": lambda d, o: impute.fill_backward(d, n("v", o), [n("p", o)], n("t", o), [n("i", o)], chunk_rows=4),
    "similar": lambda d, o: impute.fill_from_similar(d, n("v", o), [n("p", o), n("g", o)], n("i", o)),
    "nearest": lambda d, o: impute.fill_from_nearest(d, n("v", o), [n("p", o)], n("t", o)),
    "model": lambda d, o: impute.fill_by_model(d, n("v", o), [n("i", o)]).withColumn("r", F.lit(1)),
    "classes": lambda d, o: impute.fill_by_model(d, n("g", o), [n("i", o)], "classification"),
}


@pytest.mark.parametrize("name", CALLS)
def test_odd_names(plain, name):
    call = CALLS[name]
    odd = plain.withColumnsRenamed(ODD)
    want, got = call(plain, False), call(odd, True)
    assert got.columns == [ODD.get(c, c) for c in want.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
