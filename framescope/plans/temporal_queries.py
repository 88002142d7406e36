"""Volume over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import temporal
from .catalog import Tables, query


def _volume_sql(unit: str) -> str:
    return f"""
    WITH top AS (
        SELECT event_type, row_number() OVER (ORDER BY c DESC, event_type) AS r
        FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1)
        QUALIFY r <= 2
    )
    SELECT date_trunc('{unit}', e.ts)::TIMESTAMP AS period, coalesce(t.event_type, 'Other') AS series,
           coalesce(min(t.r), 3)::INT AS series_rank, count(*) AS n
    FROM events e LEFT JOIN top t ON e.event_type = t.event_type
    GROUP BY 1, 2
    """


@query("volume_by_day", _volume_sql("day"))
def volume_by_day(t: Tables) -> DataFrame:
    return temporal.volume(t.events, "ts", "event_type")


@query("volume_by_week", _volume_sql("week"))
def volume_by_week(t: Tables) -> DataFrame:
    return temporal.volume(t.events, "ts", "event_type", freq="W")


@query(
    "volume_pivot",
    f"""
    SELECT period, coalesce(sum(n) FILTER (series = 'click'), 0)::BIGINT AS click,
           coalesce(sum(n) FILTER (series = 'error'), 0)::BIGINT AS error,
           coalesce(sum(n) FILTER (series = 'purchase'), 0)::BIGINT AS purchase,
           coalesce(sum(n) FILTER (series = 'signup'), 0)::BIGINT AS signup,
           coalesce(sum(n) FILTER (series = 'view'), 0)::BIGINT AS "view",
           coalesce(sum(n) FILTER (series = 'Other'), 0)::BIGINT AS "Other"
    FROM ({_volume_sql('day')}) GROUP BY 1
    """,
)
def volume_pivot(t: Tables) -> DataFrame:
    return temporal.volume_pivot(
        t.events, "ts", "event_type", names=["click", "error", "purchase", "signup", "view", "Other"]
    )


@query("period_totals", "SELECT date_trunc('hour', ts)::TIMESTAMP AS period, count(*) AS n FROM events GROUP BY 1")
def period_totals(t: Tables) -> DataFrame:
    return temporal.period_totals(t.events, "ts", freq="h")


@query(
    "peak_periods",
    """
    SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS period, count(*) AS n
    FROM lineitem GROUP BY 1 ORDER BY n DESC, period LIMIT 3
    """,
)
def peak_periods(t: Tables) -> DataFrame:
    return temporal.peak_periods(t.lineitem, "l_shipdate")


@query(
    "stacked_bounds",
    f"""
    SELECT period, series, series_rank, n,
           (sum(n) OVER w - n)::BIGINT AS lower, (sum(n) OVER w)::BIGINT AS upper
    FROM ({_volume_sql('day')})
    WINDOW w AS (PARTITION BY period ORDER BY series_rank ROWS UNBOUNDED PRECEDING)
    """,
)
def stacked_bounds(t: Tables) -> DataFrame:
    return temporal.stacked_bounds(t.events, "ts", "event_type")


# Starts of calendar periods by date arithmetic of the SQL engine's own.
DAY = "date_trunc('day', ts)"
STARTS_SQL = {
    "2D": DAY,
    "W-SUN": f"{DAY} - to_days((isodow(ts) - 1)::INT)",
    "W-WED": f"{DAY} - to_days(((isodow(ts) + 3) % 7)::INT)",
    "Q-FEB": "make_date(year(ts) - (month(ts) < 3)::INT, CASE WHEN month(ts) IN (12, 1, 2) THEN 12 ELSE month(ts) // 3 * 3 END, 1)",
    "YE": "make_date(year(ts), 1, 1)",
    "A-JUN": "make_date(year(ts) - (month(ts) < 7)::INT, 7, 1)",
    "ME": "make_date(year(ts), month(ts), 1)",
    "B": f"{DAY} + to_days(CASE isodow(ts) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)",
    "15min": "date_trunc('minute', ts)",
}
BINS_SQL = {
    "15min": "time_bucket(INTERVAL 15 minutes, ts, TIMESTAMP '1970-01-01')",
    "7h": "time_bucket(INTERVAL 7 hours, ts, TIMESTAMP '1970-01-01')",
    "2D": "time_bucket(INTERVAL 2 days, ts, TIMESTAMP '1970-01-01')",
    "2W-SAT": "time_bucket(INTERVAL 14 days, ts, TIMESTAMP '1970-01-11')",
    "5ME": "time_bucket(INTERVAL 5 months, ts, TIMESTAMP '1970-01-01')",
    "2Q": "time_bucket(INTERVAL 6 months, ts, TIMESTAMP '1970-01-01')",
}


def _spread(t: Tables) -> DataFrame:
    """Events whose times are drawn apart over years, so that every kind of period changes."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) * 37 - F.col("event_id") * 86_400_000_000
    return t.events.select(F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"), "event_type")


SPREAD_SQL = "SELECT make_timestamp(epoch_us(ts) * 37 - event_id * 86400000000) AS ts, event_type FROM events"


@query(
    "period_starts",
    " UNION ALL ".join(
        f"SELECT '{alias}' AS freq, ({start})::TIMESTAMP AS period, count(*) AS n FROM ({SPREAD_SQL}) GROUP BY 1, 2"
        for alias, start in STARTS_SQL.items()
    ),
)
def period_starts(t: Tables) -> DataFrame:
    frames = [temporal.period_totals(_spread(t), "ts", freq).select(F.lit(freq).alias("freq"), "period", "n") for freq in STARTS_SQL]
    return reduce(DataFrame.unionAll, frames)


@query(
    "period_bins",
    " UNION ALL ".join(
        f"SELECT '{alias}' AS freq, ({start})::TIMESTAMP AS period, count(*) AS n FROM ({SPREAD_SQL}) GROUP BY 1, 2"
        for alias, start in BINS_SQL.items()
    ),
)
def period_bins(t: Tables) -> DataFrame:
    frames = [
        temporal.period_totals(_spread(t), "ts", freq, bins=True).select(F.lit(freq).alias("freq"), "period", "n") for freq in BINS_SQL
    ]
    return reduce(DataFrame.unionAll, frames)


@query(
    "volume_pivot_named",
    f"""
    SELECT period, coalesce(sum(n) FILTER (series = first), 0)::BIGINT AS "first",
           coalesce(sum(n) FILTER (series = second), 0)::BIGINT AS "second",
           coalesce(sum(n) FILTER (series = 'Other'), 0)::BIGINT AS "Other"
    FROM ({_volume_sql('day')}),
         (SELECT max(series) FILTER (series_rank = 1) AS first, max(series) FILTER (series_rank = 2) AS second FROM ({_volume_sql('day')}))
    GROUP BY 1
    """,
)
def volume_pivot_named(t: Tables) -> DataFrame:
    """The names of the series are found by the operator; the two best are renamed for the SQL."""
    wide = temporal.volume_pivot(t.events, "ts", "event_type")
    first, second = wide.columns[1:3]
    return wide.withColumnsRenamed({first: "first", second: "second"})
