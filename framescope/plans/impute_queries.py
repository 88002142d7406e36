"""Missing values replaced or removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import impute
from .catalog import Tables, query
from .profile_queries import HOLES_SQL, holes

# Events in which every purchase and every error lost its value.
GAPS_SQL = """
    SELECT event_id, ts, user_id,
           CASE WHEN event_type IN ('purchase', 'error') THEN NULL ELSE value END AS value
    FROM events
"""


def gaps(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        "ts",
        "user_id",
        F.when(~F.col("event_type").isin("purchase", "error"), F.col("value")).alias("value"),
    )


@query(
    "drop_incomplete_rows",
    f"""
    SELECT * FROM ({HOLES_SQL})
    WHERE lang <> '' AND NOT isnan(n_chars) AND source IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
    """,
)
def drop_incomplete_rows(t: Tables) -> DataFrame:
    return impute.drop_incomplete_rows(holes(t))


@query(
    "drop_sparse_columns",
    f"""
    SELECT doc_id, lang, source, isnan(n_chars) AS no_size,
           CASE WHEN isnan(n_chars) THEN 0.0 ELSE n_chars END AS n_chars
    FROM ({HOLES_SQL})
    """,
)
def drop_sparse_columns(t: Tables) -> DataFrame:
    kept = impute.drop_sparse_columns(holes(t), limit_pct=20.0)
    return kept.withColumn("no_size", F.isnan("n_chars")).withColumn("n_chars", F.nanvl("n_chars", F.lit(0.0)))


@query(
    "fill_fixed",
    f"""
    SELECT doc_id, CASE WHEN lang = '' THEN 'Unknown' ELSE lang END AS lang,
           CASE WHEN isnan(n_chars) THEN 0.0 ELSE n_chars END AS n_chars,
           coalesce(source, 'No source given') AS source, coalesce(quality, -1) AS quality, toxic
    FROM ({HOLES_SQL})
    """,
)
def fill_fixed(t: Tables) -> DataFrame:
    return impute.fill_fixed(
        holes(t), {"lang": "Unknown", "n_chars": 0.0, "source": "No source given", "quality": -1}
    )


@query(
    "fill_statistic",
    f"""
    WITH h AS ({HOLES_SQL}), g AS ({GAPS_SQL}),
    s AS (
        SELECT (SELECT median(n_chars) FROM h WHERE NOT isnan(n_chars)) AS med,
               (SELECT quality FROM h WHERE quality IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS q,
               (SELECT lang FROM h WHERE lang <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS lang
    )
    SELECT doc_id, CASE WHEN h.lang = '' THEN s.lang ELSE h.lang END AS lang,
           round(CASE WHEN isnan(n_chars) THEN med ELSE n_chars END, 6) AS n_chars,
           source, coalesce(quality, s.q) AS quality, toxic
    FROM h, s
    """,
)
def fill_statistic(t: Tables) -> DataFrame:
    filled = impute.fill_statistic(
        holes(t), {"n_chars": "median", "quality": "mode", "lang": "mode"}
    )
    return filled.withColumn("n_chars", F.round("n_chars", 6))


@query(
    "fill_mean",
    f"""
    WITH g AS ({GAPS_SQL})
    SELECT event_id, ts, user_id, round(coalesce(value, (SELECT avg(value) FROM g)), 4) AS value FROM g
    """,
)
def fill_mean(t: Tables) -> DataFrame:
    return impute.fill_statistic(gaps(t), {"value": "mean"}).withColumn("value", F.round("value", 4))


@query(
    "fill_forward",
    f"""
    SELECT event_id, ts, user_id,
           last_value(value IGNORE NULLS) OVER (
               PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value
    FROM ({GAPS_SQL})
    """,
)
def fill_forward(t: Tables) -> DataFrame:
    return impute.fill_forward(gaps(t), "value", ["user_id"], "ts", ["event_id"])


@query(
    "fill_forward_chunked",
    f"""
    SELECT event_id, ts, user_id,
           last_value(value IGNORE NULLS) OVER (
               PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value
    FROM ({GAPS_SQL})
    """,
)
def fill_forward_chunked(t: Tables) -> DataFrame:
    return impute.fill_forward(gaps(t), "value", ["user_id"], "event_id")


@query(
    "fill_backward",
    f"""
    SELECT event_id, ts, user_id,
           first_value(value IGNORE NULLS) OVER (
               PARTITION BY user_id ORDER BY ts, event_id
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
    FROM ({GAPS_SQL})
    """,
)
def fill_backward(t: Tables) -> DataFrame:
    return impute.fill_backward(gaps(t), "value", ["user_id"], "ts", ["event_id"])


@query(
    "fill_from_similar",
    f"""
    WITH h AS ({HOLES_SQL}),
    d AS (SELECT source, lang, arg_min(quality, doc_id) AS q FROM h WHERE quality IS NOT NULL GROUP BY 1, 2)
    SELECT h.doc_id, h.lang, h.source, coalesce(h.quality, d.q) AS quality
    FROM h LEFT JOIN d ON h.source IS NOT DISTINCT FROM d.source AND h.lang = d.lang
    """,
)
def fill_from_similar(t: Tables) -> DataFrame:
    table = holes(t).select("doc_id", "lang", "source", "quality")
    return impute.fill_from_similar(table, "quality", ["source", "lang"], "doc_id")


@query(
    "fill_from_donors",
    f"""
    WITH d AS (SELECT o_custkey AS user_id, arg_min(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1)
    SELECT g.event_id, g.ts, g.user_id, coalesce(g.value, d.v) AS value
    FROM ({GAPS_SQL}) g LEFT JOIN d ON g.user_id = d.user_id
    """,
)
def fill_from_donors(t: Tables) -> DataFrame:
    donors = t.orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("value"), "o_orderkey"
    )
    return impute.fill_from_donors(gaps(t), "value", ["user_id"], donors, "o_orderkey")


@query(
    "fill_by_model",
    """
    WITH g AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
               CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS price
        FROM lineitem
    ),
    m AS (SELECT regr_slope(price, l_quantity) AS a, regr_intercept(price, l_quantity) AS b FROM g)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
           round(coalesce(price, a * l_quantity + b), 2) AS price
    FROM g, m
    """,
)
def fill_by_model(t: Tables) -> DataFrame:
    li = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"),
    )
    return impute.fill_by_model(li, "price", ["l_quantity"]).withColumn("price", F.round("price", 2))


@query(
    "fill_forward_one_key",
    f"""
    SELECT event_id, ts, event_type IS NULL AS key,
           last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value
    FROM (SELECT event_type, g.* FROM ({GAPS_SQL}) g JOIN events USING (event_id))
    """,
)
def fill_forward_one_key(t: Tables) -> DataFrame:
    """One key for the whole table, dealt by ranges of about 1,000 rows."""
    one = gaps(t).select("event_id", "ts", F.col("event_id").isNull().alias("key"), "value")
    return impute.fill_forward(one, "value", ["key"], "ts", ["event_id"], chunk_rows=1_000)


@query(
    "fill_from_nearest",
    f"""
    WITH g AS ({GAPS_SQL}),
    d AS (SELECT user_id, ts, min(value) AS v FROM g WHERE value IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT g.*, d.ts AS at, d.v FROM g ASOF LEFT JOIN d ON g.user_id = d.user_id AND g.ts >= d.ts),
    a AS (SELECT g.event_id, d.ts AS at, d.v FROM g ASOF LEFT JOIN d ON g.user_id = d.user_id AND g.ts <= d.ts)
    SELECT b.event_id, b.ts, b.user_id, coalesce(b.value, CASE
        WHEN a.at IS NULL OR b.ts - b.at < a.at - b.ts THEN b.v
        WHEN b.at IS NULL OR b.ts - b.at > a.at - b.ts THEN a.v ELSE least(a.v, b.v) END) AS value
    FROM b JOIN a USING (event_id)
    """,
)
def fill_from_nearest(t: Tables) -> DataFrame:
    return impute.fill_from_nearest(gaps(t), "value", ["user_id"], "ts")


@query(
    "fill_from_nearest_donor",
    """
    WITH c AS (
        SELECT c_custkey, c_nationkey, c_custkey % 400 AS place,
               CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS balance
        FROM customer
    ),
    d AS (SELECT s_nationkey, s_suppkey % 400 AS place, s_acctbal FROM supplier),
    r AS (
        SELECT c.c_custkey, s_acctbal,
               row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c.place - d.place), s_acctbal) AS r
        FROM c JOIN d ON c_nationkey = s_nationkey
    )
    SELECT c_custkey, c_nationkey, place, coalesce(balance, s_acctbal) AS balance
    FROM c LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (c_custkey)
    """,
)
def fill_from_nearest_donor(t: Tables) -> DataFrame:
    asking = t.customer.select(
        "c_custkey", "c_nationkey", (F.col("c_custkey") % 400).alias("place"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("balance"),
    )
    donors = t.supplier.select(
        F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") % 400).alias("place"), F.col("s_acctbal").alias("balance")
    )
    return impute.fill_from_nearest_donor(asking, "balance", ["c_nationkey"], "place", donors)


@query(
    "fill_class_by_model",
    f"""
    WITH g AS (
        SELECT event_id, value, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value > 50 THEN 'high' ELSE 'low' END AS level FROM events
    )
    SELECT event_id, event_id % 7 = 0 AS was_missing,
           CASE WHEN abs(value - 50) < 5 AND event_id % 7 = 0 THEN 'near the edge' ELSE CASE WHEN value > 50 THEN 'high' ELSE 'low' END END AS level
    FROM g
    """,
)
def fill_class_by_model(t: Tables) -> DataFrame:
    """Two classes that one number separates; predictions at the edge itself are not compared."""
    missing = F.col("event_id") % 7 == 0
    level = F.when(F.col("value") > 50, "high").otherwise("low")
    events = t.events.select("event_id", "value", F.when(~missing, level).alias("level"))
    filled = impute.fill_by_model(events, "level", ["value"], kind="classification")
    edge = (F.abs(F.col("value") - 50) < 5) & missing
    return filled.select("event_id", missing.alias("was_missing"), F.when(edge, "near the edge").otherwise(F.col("level")).alias("level"))
