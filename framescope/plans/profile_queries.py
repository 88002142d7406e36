"""Shape, schema and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import profile
from ..sources import scratch
from ..functions.sizing import null_safe_join
from .catalog import Tables, query

# Documents with their labels: unlabelled documents have NULLs, French ones an empty
# language, and those of one source a NaN length.
HOLES_SQL = """
    SELECT d.doc_id,
           CASE WHEN d.lang = 'fr' THEN '' ELSE d.lang END AS lang,
           CASE WHEN d.source = 'src3' THEN 'NaN'::DOUBLE ELSE d.n_chars::DOUBLE END AS n_chars,
           CASE WHEN d.source IN ('src1', 'src2') THEN NULL ELSE d.source END AS source,
           l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def holes(t: Tables) -> DataFrame:
    d = t.documents
    return d.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("source") == "src3", float("nan"))
        .otherwise(F.col("n_chars").cast("double"))
        .alias("n_chars"),
        F.when(~F.col("source").isin("src1", "src2"), F.col("source")).alias("source"),
        "quality",
        "toxic",
    )


MISSING_SQL = f"""
    WITH h AS ({HOLES_SQL}),
    c AS (
        SELECT count(*) AS rows,
               count(*) FILTER (doc_id IS NULL) AS m0,
               count(*) FILTER (lang IS NULL OR lang = '') AS m1,
               count(*) FILTER (n_chars IS NULL OR isnan(n_chars)) AS m2,
               count(*) FILTER (source IS NULL OR source = '') AS m3,
               count(*) FILTER (quality IS NULL) AS m4,
               count(*) FILTER (toxic IS NULL) AS m5
        FROM h
    ),
    m AS (
        SELECT 0 AS ordinal, 'doc_id' AS "column", m0 AS n_missing, rows FROM c
        UNION ALL SELECT 1, 'lang', m1, rows FROM c
        UNION ALL SELECT 2, 'n_chars', m2, rows FROM c
        UNION ALL SELECT 3, 'source', m3, rows FROM c
        UNION ALL SELECT 4, 'quality', m4, rows FROM c
        UNION ALL SELECT 5, 'toxic', m5, rows FROM c
    ),
    p AS (SELECT *, n_missing * 100.0::DOUBLE / rows AS raw FROM m)
    SELECT ordinal, "column", n_missing, rows, round(raw, 6) AS pct,
           CASE WHEN raw = 0 THEN 'Clean' WHEN raw < 5 THEN 'Low'
                WHEN raw < 20 THEN 'Moderate' ELSE 'Critical' END AS severity
    FROM p
"""


@query("shape", "SELECT count(*) AS rows, 11::BIGINT AS columns FROM lineitem")
def shape(t: Tables) -> DataFrame:
    return profile.shape(t.lineitem)


@query(
    "schema_profile",
    """
    WITH s(ordinal, "column", dtype) AS (
        VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'),
               (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'),
               (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')
    ),
    c AS (
        SELECT count(*) AS rows, count(o_orderkey) AS n0, count(o_custkey) AS n1,
               count(o_orderstatus) AS n2, count(o_totalprice) AS n3,
               count(o_orderdate) AS n4, count(o_orderpriority) AS n5
        FROM orders
    )
    SELECT s.ordinal, s."column", s.dtype, c.rows,
           CASE s.ordinal WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2
                          WHEN 3 THEN n3 WHEN 4 THEN n4 ELSE n5 END AS n_present
    FROM s, c
    """,
)
def schema_profile(t: Tables) -> DataFrame:
    counts = profile.missing_counts(t.orders).select(
        "column", "rows", (F.col("rows") - F.col("n_missing")).alias("n_present")
    )
    # Both sides have one row per column of the table.
    return null_safe_join(
        profile.schema_listing(t.orders), counts, ["column"], "left", broadcast_right=True
    )


@query(
    "dtype_distribution",
    """
    WITH c AS (
        SELECT count(*) AS rows FROM lineitem
    ),
    d(dtype, n_columns) AS (
        VALUES ('double', 4), ('bigint', 3), ('string', 2), ('int', 1), ('timestamp_ntz', 1)
    )
    SELECT dtype, n_columns::BIGINT AS n_columns, n_columns * rows AS n_values FROM d, c
    """,
)
def dtype_distribution(t: Tables) -> DataFrame:
    rows = t.lineitem.agg(F.count(F.lit(1))).scalar()
    return profile.dtype_distribution(t.lineitem).withColumn(
        "n_values", F.col("n_columns") * rows
    )


@query("missing_report", MISSING_SQL)
def missing_report(t: Tables) -> DataFrame:
    return profile.missing_report(holes(t)).withColumn("pct", F.round("pct", 6))


@query("missing_while_written", MISSING_SQL)
def missing_while_written(t: Tables) -> DataFrame:
    """The same report from counts that were taken while a copy of the table was written."""
    watched, observation = profile.counting(holes(t))
    watched.write.parquet(scratch.new_path(t.spark, "copy"))
    counted = profile.observed_counts(watched, observation)
    return profile.missing_report(watched, counted=counted).withColumn("pct", F.round("pct", 6))


@query("missing_columns", f"SELECT * FROM ({MISSING_SQL}) WHERE n_missing > 0 ORDER BY pct, n_missing, \"column\"")
def missing_columns(t: Tables) -> DataFrame:
    return profile.missing_columns(holes(t)).withColumn("pct", F.round("pct", 6))


@query(
    "missing_summary",
    f"""
    SELECT count(*) FILTER (n_missing > 0) AS columns_with_missing, count(*) AS columns
    FROM ({MISSING_SQL})
    """,
)
def missing_summary(t: Tables) -> DataFrame:
    return profile.missing_summary(holes(t))
