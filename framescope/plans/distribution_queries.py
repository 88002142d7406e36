"""Counts, top-k, number summaries and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distribution as dist
from .catalog import Tables, query


@query(
    "value_counts",
    """
    WITH j AS (SELECT l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT quality AS value, count(*) AS n,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM j), 6) AS pct
    FROM j WHERE quality IS NOT NULL GROUP BY 1
    """,
)
def value_counts(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left")
    return dist.value_counts(joined, "quality").withColumn("pct", F.round("pct", 6))


@query(
    "fixed_categories",
    """
    WITH s("position", value) AS (VALUES (0, 'tl'), (1, 'en'), (2, 'fr'))
    SELECT s."position", s.value, count(d.lang) AS n,
           round(count(d.lang) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS pct
    FROM s LEFT JOIN documents d ON d.lang = s.value GROUP BY 1, 2
    """,
)
def fixed_categories(t: Tables) -> DataFrame:
    return dist.fixed_categories(t.documents, "lang", ["tl", "en", "fr"]).withColumn(
        "pct", F.round("pct", 6)
    )


@query(
    "labelled_counts",
    """
    WITH s("position", value, k) AS (VALUES (0, 'Other status', false), (1, 'Open', true))
    SELECT s."position", s.value, count(*) AS n,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS pct
    FROM s JOIN orders o ON (o.o_orderstatus = 'O') = s.k GROUP BY 1, 2
    """,
)
def labelled_counts(t: Tables) -> DataFrame:
    return dist.labelled_counts(
        t.orders, F.col("o_orderstatus") == "O", {True: "Open", False: "Other status"}
    ).withColumn("pct", F.round("pct", 6))


@query(
    "top_values",
    """
    SELECT p_name AS value, count(*) AS n,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS pct
    FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5
    """,
)
def top_values(t: Tables) -> DataFrame:
    return dist.top_values(t.part, "p_name").withColumn("pct", F.round("pct", 6))


@query(
    "top_values_with_others",
    """
    WITH c AS (SELECT p_name AS value, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1),
    top AS (SELECT value, n, false AS is_other FROM c WHERE n > 1 ORDER BY n DESC, value LIMIT 20),
    u AS (
        SELECT * FROM top
        UNION ALL
        SELECT 'Others', ((SELECT sum(n) FROM c) - coalesce((SELECT sum(n) FROM top), 0))::BIGINT, true
    )
    SELECT value, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS pct, is_other FROM u
    """,
)
def top_values_with_others(t: Tables) -> DataFrame:
    return dist.top_values_with_others(t.part, "p_name").withColumn("pct", F.round("pct", 6))


@query(
    "zero_inflation",
    """
    SELECT metric, n_numeric, n_zero, round(n_zero * 100.0::DOUBLE / n_numeric, 6) AS zero_pct FROM (
        SELECT 'l_discount' AS metric, count(l_discount) AS n_numeric,
               count(*) FILTER (l_discount = 0) AS n_zero FROM lineitem
        UNION ALL
        SELECT 'l_tax', count(l_tax), count(*) FILTER (l_tax = 0) FROM lineitem
    )
    """,
)
def zero_inflation(t: Tables) -> DataFrame:
    return dist.zero_inflation(t.lineitem, ["l_discount", "l_tax"]).withColumn(
        "zero_pct", F.round("zero_pct", 6)
    )


def _profile_sql(table: str, metrics: list[str]) -> str:
    parts = [
        f"""
        SELECT '{m}' AS metric, count({m}) AS n_numeric, count(*) FILTER ({m} = 0) AS n_zero,
               round(count(*) FILTER ({m} = 0) * 100.0::DOUBLE / count({m}), 6) AS zero_pct,
               count(*) FILTER ({m} > 0) AS n_positive,
               round(quantile_cont({m}, 0.5) FILTER ({m} > 0), 6) AS median,
               round(avg({m}) FILTER ({m} > 0), 6) AS mean,
               round(quantile_cont({m}, 0.25) FILTER ({m} > 0), 6) AS q1,
               round(quantile_cont({m}, 0.75) FILTER ({m} > 0), 6) AS q3,
               max({m}) FILTER ({m} > 0) AS max,
               max({m}) FILTER ({m} > 0) / greatest(min({m}) FILTER ({m} > 0), 1.0) > 50 AS log_scale,
               CASE WHEN count({m}) = 0 THEN 'no_data'
                    WHEN count(*) FILTER ({m} > 0) = 0 THEN 'no_positive' ELSE 'ok' END AS status
        FROM (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in metrics)} FROM {table})
        """
        for m in metrics
    ]
    return " UNION ALL ".join(parts)


def _rounded(profile: DataFrame) -> DataFrame:
    return profile.withColumns(
        {c: F.round(c, 6) for c in ("zero_pct", "median", "mean", "q1", "q3")}
    )


@query("positive_summary", _profile_sql("customer", ["c_acctbal"]))
def positive_summary(t: Tables) -> DataFrame:
    return _rounded(dist.metric_profile(t.customer, ["c_acctbal"]))


LINE_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("metric_profile", _profile_sql("lineitem", LINE_METRICS))
def metric_profile(t: Tables) -> DataFrame:
    return _rounded(dist.metric_profile(t.lineitem, LINE_METRICS))


@query("metric_profile_integers", _profile_sql("documents", ["n_chars"]))
def metric_profile_integers(t: Tables) -> DataFrame:
    return _rounded(dist.metric_profile(t.documents, ["n_chars"]))


@query(
    "group_stats",
    """
    SELECT o_orderpriority AS "group",
           round(coalesce(avg(v), 0), 6) AS mean,
           round(coalesce(quantile_cont(v, 0.25), 0), 6) AS p25,
           round(coalesce(quantile_cont(v, 0.75), 0), 6) AS p75,
           round(coalesce(quantile_cont(v, 0.9), 0), 6) AS p90,
           count(v) AS n, count(*) AS rows,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS pct
    FROM (SELECT o_orderpriority,
                 CASE WHEN o_orderpriority <> '5-LOW' AND o_totalprice > 0 THEN o_totalprice END AS v
          FROM orders)
    GROUP BY 1
    """,
)
def group_stats(t: Tables) -> DataFrame:
    # One group has no positive values at all.
    o = t.orders
    price = F.when(o.o_orderpriority != "5-LOW", o.o_totalprice).otherwise(F.lit(0.0))
    stats = dist.group_stats(o.select("o_orderpriority", price.alias("price")), "price", "o_orderpriority")
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "p25", "p75", "p90", "pct")})


def _linear_sql(table: str, column: str) -> str:
    return f"""
    WITH x AS (SELECT {column}::DOUBLE AS x FROM {table} WHERE {column} > 0),
    b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
    r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
                 CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM b),
    g AS (SELECT x, lo, hi, (hi - lo) / 30 AS st,
                 least(floor((x - lo) / (hi - lo) * 30), 29)::INT AS i FROM x, r),
    p AS (SELECT (i - CASE WHEN x < lo + i * st THEN 1 ELSE 0 END
                    + CASE WHEN i < 29 AND x >= lo + (i + 1) * st THEN 1 ELSE 0 END)::INT AS bin FROM g),
    c AS (SELECT bin, count(*) AS n FROM p GROUP BY 1)
    SELECT '{column}' AS metric, 'linear' AS scale, s.bin::INT AS bin,
           round(lo + s.bin * ((hi - lo) / 30), 6) AS "left",
           round(CASE WHEN s.bin = 29 THEN hi ELSE lo + (s.bin + 1) * ((hi - lo) / 30) END, 6) AS "right",
           coalesce(c.n, 0) AS n
    FROM range(30) AS s(bin) CROSS JOIN r LEFT JOIN c ON c.bin = s.bin
    """


def _log_sql(table: str, column: str) -> str:
    return f"""
    WITH x AS (SELECT {column}::DOUBLE AS x FROM {table} WHERE {column} > 0),
    b AS (SELECT floor(log10(min(x))) AS lo, ceil(log10(max(x))) AS hi FROM x),
    r AS (SELECT lo, greatest(hi, lo + 1) AS hi FROM b),
    c AS (SELECT least(floor((log10(x) - lo) / (hi - lo) * 29), 28)::INT AS bin, count(*) AS n
          FROM x, r GROUP BY 1)
    SELECT '{column}' AS metric, 'log' AS scale, s.bin::INT AS bin,
           round(pow(10.0, lo + (hi - lo) * s.bin / 29), 6) AS "left",
           round(pow(10.0, lo + (hi - lo) * (s.bin + 1) / 29), 6) AS "right",
           coalesce(c.n, 0) AS n
    FROM range(29) AS s(bin) CROSS JOIN r LEFT JOIN c ON c.bin = s.bin
    """


def _edges(histogram: DataFrame) -> DataFrame:
    return histogram.withColumns({c: F.round(c, 6) for c in ("left", "right")})


@query("histogram_linear", _linear_sql("part", "p_retailprice"))
def histogram_linear(t: Tables) -> DataFrame:
    return _edges(dist.histogram(t.part, ["p_retailprice"], "linear"))


@query("histogram_log", _log_sql("documents", "n_chars"))
def histogram_log(t: Tables) -> DataFrame:
    return _edges(dist.histogram(t.documents, ["n_chars"], "log"))


@query(
    "metric_histograms",
    f"""
    SELECT * FROM ({_linear_sql('lineitem', 'l_quantity')})
    UNION ALL SELECT * FROM ({_log_sql('lineitem', 'l_extendedprice')})
    UNION ALL SELECT * FROM ({_linear_sql('lineitem', 'l_tax')})
    """,
)
def metric_histograms(t: Tables) -> DataFrame:
    return _edges(dist.histogram(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]))
