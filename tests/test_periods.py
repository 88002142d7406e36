"""Periods of every alias against pandas, and bins of several units."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest

from framescope.functions.periods import parse, period_start
from framescope.operators import temporal

ALIASES = (
    "Y A Y-MAR A-JUN 3Y-DEC Q 2Q Q-JAN Q-FEB Q-MAR Q-NOV Q-DEC M 2M W 2W W-SUN W-MON W-TUE W-WED W-THU W-FRI W-SAT "
    "B D d 2D 15min min T 3h H h s S ms L us U"
).split()


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_starts_are_those_of_pandas(spark):
    rng = random.Random(3)
    start = dt.datetime(1965, 1, 1)
    times = [start + dt.timedelta(microseconds=rng.randrange(60 * 365 * 86_400_000_000)) for _ in range(200)]
    times += [dt.datetime(2024, m, d) for m in (1, 2, 3, 12) for d in (1, 2, 3, 28)] + [dt.datetime(2024, 2, 29, 23, 59, 59, 999999), dt.datetime(1970, 1, 1)]
    df = spark.createDataFrame(list(enumerate(times)), "i int, ts timestamp_ntz")
    got = df.select("i", *[period_start(df["ts"], alias).alias(f"c{n}") for n, alias in enumerate(ALIASES)]).orderBy("i").collect()
    series = pd.Series(times)
    for n, alias in enumerate(ALIASES):
        wanted = series.dt.to_period(alias).dt.to_timestamp()
        assert [r[f"c{n}"] for r in got] == wanted.dt.to_pydatetime().tolist(), alias


def test_aliases_of_period_ends(spark):
    assert parse("ME") == parse("M") and parse("QE-FEB") == parse("Q-FEB") and parse("YE") == parse("Y")
    for alias in ("", "X", "D-MON", "W-ABC", "Q-FOO", "0D", "-1D", "1h30min", "m"):
        with pytest.raises(ValueError):
            parse(alias)


def test_bins_lie_side_by_side(spark):
    times = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i) for i in range(3000)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    for alias, width in (("15min", 900), ("7h", 25_200), ("2D", 172_800), ("2W-SAT", 1_209_600)):
        got = [r["period"] for r in temporal.period_totals(df, "ts", alias, bins=True).orderBy("period").collect()]
        assert {(b - a).total_seconds() for a, b in zip(got, got[1:])} <= {width}
        first = dt.datetime(1970, 1, 11) if alias.startswith("2W") else dt.datetime(1970, 1, 1)
        assert all((p - first).total_seconds() % width == 0 for p in got)
    with pytest.raises(ValueError, match="business"):
        period_start(df["ts"], "2B", bins=True)


def test_number_of_series_is_bounded(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "a")], "ts timestamp_ntz, s string")
    for top in (-1, temporal.MAX_TOP + 1):
        with pytest.raises(ValueError, match="top series"):
            temporal.volume(df, "ts", "s", top=top)
    assert temporal.volume(df, "ts", "s", top=0).collect()[0]["series"] == "Other"
