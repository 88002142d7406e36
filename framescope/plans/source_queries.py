"""Sources and sinks, through tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distribution, quality
from ..sources import ingest, readers, scratch, sinks
from .catalog import Tables, query


@query(
    "csv_round_trip",
    """
    SELECT doc_id, md5(text) AS text_md5, length(text) AS text_length,
           CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang, n_chars
    FROM documents
    """,
)
def csv_round_trip(t: Tables) -> DataFrame:
    path = scratch.new_path(t.spark, "documents") + ".csv"
    lang = F.when(F.col("lang") == "fr", "NA").otherwise(F.col("lang"))
    t.documents.select("doc_id", "text", lang.alias("lang"), "n_chars").write.options(
        header=True, quote='"', escape='"', quoteAll=True
    ).csv(path)
    back = readers.as_frame(t.spark, path, "doc_id bigint, text string, lang string, n_chars bigint")
    return back.select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        F.length("text").cast("bigint").alias("text_length"),
        "lang",
        "n_chars",
    )


@query("ingest_once", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def ingest_once(t: Tables) -> DataFrame:
    source = scratch.new_path(t.spark, "orders") + ".json"
    target = scratch.new_path(t.spark, "orders") + ".parquet"
    t.orders.select("o_orderkey", "o_orderstatus").write.json(source)
    schema = "o_orderkey bigint, o_orderstatus string"
    ingest.ingest(t.spark, source, target, schema)
    # The second call finds the target and leaves it alone.
    kept = ingest.ingest(t.spark, source, target, schema)
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "report_sink",
    """
    SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1
    """,
)
def report_sink(t: Tables) -> DataFrame:
    out = scratch.new_path(t.spark, "reports")
    report = distribution.value_counts(t.part, "p_brand").select("value", "n")
    base = sinks.base_name(f"{t.folder}/part.parquet")
    path = sinks.write_report(report, out, base, "brands")
    return t.spark.read.parquet(path)


@query(
    "csv_malformed",
    """
    SELECT 'row' AS kind, doc_id::VARCHAR AS value, n_chars AS n FROM documents WHERE lang NOT IN ('fr', 'de')
    UNION ALL
    SELECT 'record', CASE lang WHEN 'fr' THEN doc_id::VARCHAR || ',fr'
                     ELSE doc_id::VARCHAR || ',de,' || n_chars::VARCHAR || ' chars' END, NULL
    FROM documents WHERE lang IN ('fr', 'de')
    UNION ALL
    SELECT 'Malformed Rows', 'issue', count(*) FROM documents WHERE lang IN ('fr', 'de') HAVING count(*) > 0
    """,
)
def csv_malformed(t: Tables) -> DataFrame:
    """French rows lack a field and German ones have text for a number: both are put aside and reported."""
    source, target, aside = (scratch.new_path(t.spark, name) for name in ("ragged", "ragged-rows", "ragged-aside"))
    lang = F.col("lang")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), "lang", F.when(lang == "de", F.concat(F.col("n_chars").cast("string"), F.lit(" chars"))).when(lang != "fr", F.col("n_chars").cast("string")))
    # One column whose name is the header line, written as it is.
    raw = t.documents.select(line.alias("doc_id,lang,n_chars"))
    raw.write.options(header=True, sep="\u0001", quote="", escape="").csv(f"{source}.csv")
    rows = ingest.ingest(t.spark, f"{source}.csv", target, "doc_id bigint, lang string, n_chars bigint", quarantine=aside)
    malformed = t.spark.read.parquet(aside)
    report = quality.exception_report(rows, quality.Expectations(), malformed)
    nothing = F.lit(None).cast("bigint")
    return (
        rows.select(F.lit("row").alias("kind"), F.col("doc_id").cast("string").alias("value"), F.col("n_chars").alias("n"))
        .unionAll(malformed.select(F.lit("record"), "record", nothing))
        .unionAll(report.select("section", "severity", "n"))
    )


@query("ingest_changed", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def ingest_changed(t: Tables) -> DataFrame:
    source = scratch.new_path(t.spark, "nation") + ".json"
    target = scratch.new_path(t.spark, "nation") + ".parquet"
    t.nation.where("n_regionkey < 2").select("n_regionkey").write.json(source)
    ingest.ingest(t.spark, source, target, "n_regionkey int")
    t.nation.where("n_regionkey >= 2").select("n_regionkey").write.mode("append").json(source)
    # The source has more files now, so the table is made again.
    again = ingest.ingest(t.spark, source, target, "n_regionkey int", refresh=True)
    return again.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
