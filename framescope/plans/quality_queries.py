"""Data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from .catalog import Tables, query

# Fragments of source names and words that mark a value as invalid in these tables.
BAD_SOURCES = ["SRC1", "src7"]
BAD_WORDS = ["mail", "password", "http", "###"]
ALLOWED_LANGUAGES = ["en", "de"]

# Documents in which a language is white space, and an id that was stored as a decimal.
UNTIDY_SQL = """
    SELECT doc_id, text, source,
           CASE WHEN lang = 'es' THEN chr(9) || chr(160) || chr(10) || ' ' ELSE lang END AS lang,
           CASE WHEN source = 'src5' THEN NULL ELSE doc_id::DOUBLE END AS ref,
           CASE WHEN lang = 'fr' THEN source ELSE n_chars::VARCHAR END AS size_text
    FROM documents
"""


def untidy(t: Tables) -> DataFrame:
    d = t.documents
    return d.select(
        "doc_id",
        "text",
        "source",
        F.when(d.lang == "es", "\t\u00a0\n ").otherwise(d.lang).alias("lang"),
        F.when(d.source != "src5", d.doc_id.cast("double")).alias("ref"),
        F.when(d.lang == "fr", d.source).otherwise(d.n_chars.cast("string")).alias("size_text"),
    )


EXPECTED = quality.Expectations(
    keys=["text"],
    types={"size_text": "bigint", "doc_id": "bigint"},
    keywords={"source": BAD_SOURCES},
    not_blank=["lang", "source"],
    domains={"lang": ALLOWED_LANGUAGES},
    ids=["ref"],
)


@query(
    "duplicate_rows",
    """
    SELECT n, rows, round(n * 100.0::DOUBLE / rows, 6) AS pct FROM (
        SELECT (count(*) - count(DISTINCT text))::BIGINT AS n, count(*) AS rows FROM documents
    )
    """,
)
def duplicate_rows(t: Tables) -> DataFrame:
    return quality.duplicate_rows(t.documents, ["text"]).withColumn("pct", F.round("pct", 6))


@query(
    "duplicate_finding",
    """
    SELECT 'l_orderkey, l_linenumber' AS "column", n, round(n * 100.0::DOUBLE / rows, 6) AS pct,
           'issue' AS severity
    FROM (SELECT sum(c - 1)::BIGINT AS n, sum(c)::BIGINT AS rows
          FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber))
    WHERE n > 0
    """,
)
def duplicate_finding(t: Tables) -> DataFrame:
    found = quality.duplicate_finding(t.lineitem, ["l_orderkey", "l_linenumber"])
    return found.withColumn("pct", F.round("pct", 6))


@query(
    "type_conformance",
    f"""
    WITH u AS ({UNTIDY_SQL}),
    c AS (
        SELECT count(*) AS rows,
               count(*) FILTER (size_text IS NOT NULL AND TRY_CAST(size_text AS BIGINT) IS NULL) AS a,
               count(*) FILTER (source IS NOT NULL AND TRY_CAST(source AS DOUBLE) IS NULL) AS b
        FROM u
    )
    SELECT 'size_text' AS "column", 'string' AS stored_type, 'bigint' AS expected_type,
           a AS n, rows, round(a * 100.0::DOUBLE / rows, 6) AS pct FROM c
    UNION ALL
    SELECT 'source', 'string', 'double', b, rows, round(b * 100.0::DOUBLE / rows, 6) FROM c
    """,
)
def type_conformance(t: Tables) -> DataFrame:
    return quality.type_conformance(
        untidy(t), {"size_text": "bigint", "source": "double"}
    ).withColumn("pct", F.round("pct", 6))


@query(
    "invalid_values",
    """
    WITH c AS (
        SELECT count(*) AS rows,
               count(*) FILTER (contains(lower(source), 'src1') OR contains(lower(source), 'src7')) AS a,
               count(*) FILTER (contains(lower(text), 'mail') OR contains(lower(text), 'password')
                             OR contains(lower(text), 'http') OR contains(lower(text), '###')) AS b
        FROM documents
    )
    SELECT 'source' AS "column", a AS n, rows, round(a * 100.0::DOUBLE / rows, 6) AS pct FROM c
    UNION ALL
    SELECT 'text', b, rows, round(b * 100.0::DOUBLE / rows, 6) FROM c
    """,
)
def invalid_values(t: Tables) -> DataFrame:
    words = {"source": BAD_SOURCES, "text": BAD_WORDS}
    return quality.invalid_values(t.documents, words).withColumn("pct", F.round("pct", 6))


@query(
    "top_invalid",
    """
    SELECT source AS value, count(*) AS n FROM documents
    WHERE contains(lower(source), 'src1') OR contains(lower(source), 'src7')
    GROUP BY 1 ORDER BY n DESC, value LIMIT 5
    """,
)
def top_invalid(t: Tables) -> DataFrame:
    return quality.top_invalid(t.documents, "source", BAD_SOURCES)


@query(
    "blank_strings",
    f"""
    WITH u AS ({UNTIDY_SQL}),
    c AS (SELECT count(*) AS rows, count(*) FILTER (regexp_full_match(lang, '[\\x09-\\x0D\\x{{A0}} ]+')) AS a,
                 count(*) FILTER (trim(source) = '') AS b FROM u)
    SELECT 'lang' AS "column", a AS n, rows, round(a * 100.0::DOUBLE / rows, 6) AS pct FROM c
    UNION ALL
    SELECT 'source', b, rows, round(b * 100.0::DOUBLE / rows, 6) FROM c
    """,
)
def blank_strings(t: Tables) -> DataFrame:
    return quality.blank_strings(untidy(t), ["lang", "source"]).withColumn("pct", F.round("pct", 6))


@query(
    "domain_violations",
    """
    SELECT lang AS value, count(*) AS n,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS pct
    FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY 1
    """,
)
def domain_violations(t: Tables) -> DataFrame:
    return quality.domain_violations(t.documents, "lang", ALLOWED_LANGUAGES).withColumn(
        "pct", F.round("pct", 6)
    )


@query(
    "category_breakdown",
    """
    SELECT p_brand AS value, count(*) AS n,
           round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS pct
    FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 6
    """,
)
def category_breakdown(t: Tables) -> DataFrame:
    return quality.category_breakdown(t.part, "p_brand").withColumn("pct", F.round("pct", 6))


@query(
    "float_ids",
    f"""
    WITH u AS ({UNTIDY_SQL}),
    c AS (SELECT count(*) AS rows, count(ref) AS a FROM u)
    SELECT 'ref' AS "column", a AS n, rows, round(a * 100.0::DOUBLE / rows, 6) AS pct FROM c
    UNION ALL SELECT 'source', 0, rows, 0.0 FROM c
    UNION ALL SELECT 'doc_id', 0, rows, 0.0 FROM c
    """,
)
def float_ids(t: Tables) -> DataFrame:
    return quality.float_ids(untidy(t), ["ref", "source", "doc_id"]).withColumn("pct", F.round("pct", 6))


EXCEPTIONS_SQL = f"""
    WITH u AS ({UNTIDY_SQL}),
    c AS (
        SELECT count(*) AS rows,
               (count(*) - count(DISTINCT text))::BIGINT AS dup,
               count(*) FILTER (TRY_CAST(size_text AS BIGINT) IS NULL) AS typ,
               count(*) FILTER (contains(lower(source), 'src1') OR contains(lower(source), 'src7')) AS kw,
               count(*) FILTER (regexp_full_match(lang, '[\\x09-\\x0D\\x{{A0}} ]+')) AS blank,
               count(*) FILTER (lang NOT IN ('en', 'de')) AS dom,
               count(ref) AS ids
        FROM u
    ),
    r AS (
        SELECT 'Duplicate Rows' AS section, 'text' AS "column", 'duplicate rows' AS finding, dup AS n, rows,
               'issue' AS severity, 'rows beyond the first of their key' AS note FROM c WHERE dup > 0
        UNION ALL
        SELECT 'Wrong Data Types', 'size_text', 'wrong type', typ, rows, 'warning',
               'stored as string, expected bigint' FROM c
        UNION ALL
        SELECT 'Inconsistent Values', 'source', 'invalid values', kw, rows, 'warning',
               'contains a listed keyword' FROM c WHERE kw > 0
        UNION ALL
        SELECT 'Inconsistent Values', 'lang', 'blank strings', blank, rows, 'warning',
               'white space instead of a missing value' FROM c WHERE blank > 0
        UNION ALL
        SELECT 'Inconsistent Values', 'lang', 'unexpected values', dom, rows, 'warning',
               'allowed: en, de' FROM c WHERE dom > 0
        UNION ALL
        SELECT 'Inconsistent Values', 'ref', 'ids stored as decimals', ids, rows, 'warning',
               'cast to text before use' FROM c WHERE ids > 0
    )
    SELECT section, "column", finding, n, round(n * 100.0::DOUBLE / rows, 6) AS pct, severity, note FROM r
"""


@query("exception_report", EXCEPTIONS_SQL)
def exception_report(t: Tables) -> DataFrame:
    return quality.exception_report(untidy(t), EXPECTED).withColumn("pct", F.round("pct", 6))


@query(
    "exception_breakdown",
    f"""
    WITH u AS ({UNTIDY_SQL}),
    a AS (SELECT source AS value, count(*) AS n FROM u
          WHERE contains(lower(source), 'src1') OR contains(lower(source), 'src7')
          GROUP BY 1 ORDER BY n DESC, value LIMIT 5),
    b AS (SELECT lang AS value, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, value LIMIT 6)
    SELECT 'source' AS "column", value, n FROM a UNION ALL SELECT 'lang', value, n FROM b
    """,
)
def exception_breakdown(t: Tables) -> DataFrame:
    return quality.exception_breakdown(untidy(t), EXPECTED)


@query(
    "quality_rollup",
    f"""
    SELECT count(*) FILTER (severity = 'issue') AS issues,
           count(*) FILTER (severity = 'warning') AS warnings,
           (SELECT count(*) FROM documents) AS rows, 6::BIGINT AS columns
    FROM ({EXCEPTIONS_SQL})
    """,
)
def quality_rollup(t: Tables) -> DataFrame:
    return quality.quality_rollup(untidy(t), EXPECTED)


@query(
    "missing_explained",
    """
    WITH j AS (
        SELECT l.quality, l.doc_id IS NOT NULL AS flag
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    ),
    g AS (SELECT flag, count(*) FILTER (quality IS NULL) AS n_missing, count(*) AS rows FROM j GROUP BY 1)
    SELECT flag, n_missing, rows, round(n_missing * 100.0::DOUBLE / rows, 6) AS pct,
           (SELECT bool_and(n_missing IN (0, rows)) AND bool_or(n_missing = rows) AND bool_or(n_missing = 0)
            FROM g) AS explained
    FROM g
    """,
)
def missing_explained(t: Tables) -> DataFrame:
    labels = t.labels.withColumn("labelled", F.lit(True))
    joined = t.documents.join(labels, "doc_id", "left").select(
        "quality", F.coalesce("labelled", F.lit(False)).alias("labelled")
    )
    return quality.missing_explained(joined, "quality", "labelled").withColumn("pct", F.round("pct", 6))


@query(
    "missing_unexplained",
    """
    WITH j AS (
        SELECT l.quality, d.lang AS flag
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    ),
    g AS (SELECT flag, count(*) FILTER (quality IS NULL) AS n_missing, count(*) AS rows FROM j GROUP BY 1)
    SELECT flag, n_missing, rows, round(n_missing * 100.0::DOUBLE / rows, 6) AS pct,
           (SELECT bool_and(n_missing IN (0, rows)) AND bool_or(n_missing = rows) AND bool_or(n_missing = 0)
            FROM g) AS explained
    FROM g
    """,
)
def missing_unexplained(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left").select("quality", "lang")
    return quality.missing_explained(joined, "quality", "lang").withColumn("pct", F.round("pct", 6))
