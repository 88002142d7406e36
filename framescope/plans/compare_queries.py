"""Comparison of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare
from .catalog import Tables, query

JOINED_SQL = """
    SELECT d.doc_id, d.lang, d.n_chars,
           CASE l.quality WHEN 1 THEN 'Good' WHEN 0 THEN 'Poor' END AS quality,
           CASE l.toxic WHEN 1 THEN 'Toxic' WHEN 0 THEN 'Not Toxic' END AS toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def joined(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        "lang",
        "n_chars",
        F.when(F.col("quality") == 1, "Good").when(F.col("quality") == 0, "Poor").alias("quality"),
        F.when(F.col("toxic") == 1, "Toxic").when(F.col("toxic") == 0, "Not Toxic").alias("toxic"),
    )


@query(
    "metric_by_group",
    f"""
    WITH j AS ({JOINED_SQL})
    SELECT quality AS "group", round(avg(n_chars), 6) AS mean,
           round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.75), 6) AS p75,
           round(quantile_cont(n_chars, 0.9), 6) AS p90, count(n_chars) AS n, count(*) AS rows,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM j), 6) AS pct
    FROM j WHERE quality IN ('Good', 'Poor') GROUP BY 1
    """,
)
def metric_by_group(t: Tables) -> DataFrame:
    stats = compare.metric_by_group(joined(t), "n_chars", "quality", ["Good", "Poor"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "p25", "p75", "p90", "pct")})


@query(
    "metric_means_by_group",
    """
    SELECT c_mktsegment AS "group",
           round(coalesce(avg(c_acctbal) FILTER (c_acctbal > 0), 0), 6) AS mean_c_acctbal,
           round(coalesce(avg(c_nationkey) FILTER (c_nationkey > 0), 0), 6) AS mean_c_nationkey,
           count(*) AS rows, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM customer), 6) AS pct
    FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1
    """,
)
def metric_means_by_group(t: Tables) -> DataFrame:
    means = compare.metric_means_by_group(
        t.customer, ["c_acctbal", "c_nationkey"], "c_mktsegment", ["BUILDING", "MACHINERY"]
    )
    return means.withColumns({c: F.round(c, 6) for c in ("mean_c_acctbal", "mean_c_nationkey", "pct")})


COMPOSITION_SQL = f"""
    WITH j AS (SELECT * FROM ({JOINED_SQL}) WHERE lang IN ('en', 'fr')),
    p(part, part_position) AS (VALUES ('Toxic', 0), ('Not Toxic', 1), ('Unclear', 2)),
    g AS (SELECT lang, count(toxic) AS a FROM j GROUP BY 1),
    c AS (SELECT lang, toxic, count(*) AS n FROM j GROUP BY 1, 2)
    SELECT g.lang AS "group", p.part, p.part_position::INT AS part_position, coalesce(c.n, 0) AS n,
           coalesce(c.n, 0) * 100.0::DOUBLE / g.a AS pct
    FROM g CROSS JOIN p LEFT JOIN c ON c.lang = g.lang AND c.toxic = p.part
"""
PARTS = ["Toxic", "Not Toxic", "Unclear"]


@query(
    "composition",
    f'SELECT "group", part, part_position, n, round(pct, 6) AS pct FROM ({COMPOSITION_SQL})',
)
def composition(t: Tables) -> DataFrame:
    return compare.composition(joined(t), "lang", "toxic", PARTS, ["en", "fr"]).withColumn(
        "pct", F.round("pct", 6)
    )


@query(
    "composition_bounds",
    f"""
    SELECT "group", part, part_position, n, round(pct, 6) AS pct,
           round(sum(pct) OVER w - pct, 6) + 0.0 AS lower, round(sum(pct) OVER w, 6) AS upper
    FROM ({COMPOSITION_SQL})
    WINDOW w AS (PARTITION BY "group" ORDER BY part_position ROWS UNBOUNDED PRECEDING)
    """,
)
def composition_bounds(t: Tables) -> DataFrame:
    bounds = compare.composition_bounds(
        compare.composition(joined(t), "lang", "toxic", PARTS, ["en", "fr"])
    )
    return bounds.withColumns({c: F.round(c, 6) for c in ("pct", "lower", "upper")})


@query(
    "composition_with_metric",
    f"""
    SELECT c."group", c.part, c.part_position, c.n, round(c.pct, 6) AS pct,
           round(m.metric_mean, 6) AS metric_mean, m.group_rows
    FROM ({COMPOSITION_SQL}) c
    JOIN (SELECT lang, avg(n_chars) FILTER (n_chars > 0) AS metric_mean, count(*) AS group_rows
          FROM documents GROUP BY 1) m ON m.lang = c."group"
    """,
)
def composition_with_metric(t: Tables) -> DataFrame:
    both = compare.composition(joined(t), "lang", "toxic", PARTS, ["en", "fr"], metric="n_chars")
    return both.withColumns({c: F.round(c, 6) for c in ("pct", "metric_mean")})


TRAITS = {"Language": "lang", "Quality": "quality", "Toxicity": "toxic"}
TRAIT_MEANS_SQL = f"""
    WITH j AS ({JOINED_SQL}),
    l AS (
        SELECT 'Language' AS trait, lang AS "group", n_chars FROM j WHERE lang IN ('en', 'fr')
        UNION ALL SELECT 'Quality', quality, n_chars FROM j WHERE quality IS NOT NULL
        UNION ALL SELECT 'Toxicity', toxic, n_chars FROM j WHERE toxic IS NOT NULL
    )
    SELECT trait, "group", avg(n_chars) FILTER (n_chars > 0) AS mean,
           count(*) FILTER (n_chars > 0) AS n
    FROM l GROUP BY 1, 2
"""


@query("trait_means", f'SELECT trait, "group", round(mean, 6) AS mean, n FROM ({TRAIT_MEANS_SQL})')
def trait_means(t: Tables) -> DataFrame:
    means = compare.trait_means(joined(t), TRAITS, "n_chars", {"Language": ["en", "fr"]})
    return means.withColumn("mean", F.round("mean", 6))


@query(
    "trait_lift",
    f"""
    SELECT trait, round(min(mean), 6) AS low_mean, round(max(mean), 6) AS high_mean,
           round(CASE WHEN min(mean) > 0 THEN max(mean) / min(mean) ELSE 1 END, 6) AS lift
    FROM ({TRAIT_MEANS_SQL}) GROUP BY 1
    """,
)
def trait_lift(t: Tables) -> DataFrame:
    lift = compare.trait_lift(joined(t), TRAITS, "n_chars", {"Language": ["en", "fr"]})
    return lift.withColumns({c: F.round(c, 6) for c in ("low_mean", "high_mean", "lift")})


@query(
    "headline",
    """
    WITH c AS (
        SELECT count(*) AS a, count(*) FILTER (l_returnflag = 'R') AS r,
               count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_discount = 0) AS f
        FROM lineitem
    )
    SELECT measure, n, round(n * 100.0::DOUBLE / a, 6) AS pct FROM (
        SELECT 'rows' AS measure, a AS n, a FROM c
        UNION ALL SELECT 'returned', r, a FROM c
        UNION ALL SELECT 'open', o, a FROM c
        UNION ALL SELECT 'full price', f, a FROM c
    )
    """,
)
def headline(t: Tables) -> DataFrame:
    conditions = {
        "returned": F.col("l_returnflag") == "R",
        "open": F.col("l_linestatus") == "O",
        "full price": F.col("l_discount") == 0,
    }
    return compare.headline(t.lineitem, conditions).withColumn("pct", F.round("pct", 6))
