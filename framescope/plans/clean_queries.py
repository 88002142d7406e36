"""Projections, casts, recodes and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordlists import LANGUAGE_LABELS, METRIC_RENAMES
from ..operators import clean
from .catalog import Tables, query


@query(
    "bool_normalise",
    """
    SELECT d.doc_id,
           coalesce(lower(trim(CASE WHEN l.quality = 1 AND d.lang = 'en' THEN 'YES'
                                    WHEN l.quality = 1 AND d.lang = 'fr' THEN 'True'
                                    WHEN l.quality = 1 THEN '1'
                                    WHEN l.toxic = 1 THEN '1.0'
                                    WHEN l.quality = 0 THEN 'no' END)) IN ('true', '1', 'yes'), false) AS flag
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def bool_normalise(t: Tables) -> DataFrame:
    good = F.col("quality") == 1
    raw = (
        F.when(good & (F.col("lang") == "en"), "\t\u00a0YES\n")
        .when(good & (F.col("lang") == "fr"), "True")
        .when(good, "1")
        .when(F.col("toxic") == 1, "1.0")
        .when(F.col("quality") == 0, "no")
    )
    mixed = t.documents.join(t.labels, "doc_id", "left").select("doc_id", raw.alias("flag"))
    return clean.normalise_flags(mixed, ["flag"])


@query(
    "parse_times",
    """
    SELECT event_id,
           CASE event_type
               WHEN 'view' THEN date_trunc('second', ts)
               WHEN 'click' THEN date_trunc('second', ts) - INTERVAL 8 HOUR
               WHEN 'purchase' THEN date_trunc('second', ts)
               WHEN 'signup' THEN date_trunc('day', ts)
           END AS at
    FROM events
    """,
)
def parse_times(t: Tables) -> DataFrame:
    ts, kind = F.col("ts"), F.col("event_type")
    raw = (
        F.when(kind == "view", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == "click", F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+08:00'"))
        .when(kind == "purchase", F.concat(F.lit("Mon "), F.date_format(ts, "MMM dd HH:mm:ss '+0000' yyyy")))
        .when(kind == "signup", F.date_format(ts, "yyyy-MM-dd"))
        .otherwise("not a time")
    )
    return clean.parse_times(t.events.select("event_id", raw.alias("at")), ["at"])


@query(
    "ids_to_text",
    """
    SELECT event_id,
           CASE WHEN event_type = 'error' THEN NULL
                WHEN event_type = 'view' THEN event_id::VARCHAR || '.5'
                ELSE ((972890161400000 + event_id)::BIGINT)::VARCHAR END AS id
    FROM events
    """,
)
def ids_to_text(t: Tables) -> DataFrame:
    number = (F.lit(972890161400000) + F.col("event_id")).cast("double")
    damaged = t.events.select(
        "event_id", F.when(F.col("event_type") == "view", F.col("event_id") + 0.5).when(F.col("event_type") != "error", number).alias("id")
    )
    return clean.ids_to_text(damaged, ["id"])


@query(
    "rename_known",
    """
    SELECT l_orderkey, l_linenumber, l_quantity AS "retweetCount", l_tax AS "likeCount", l_discount AS other
    FROM lineitem
    """,
)
def rename_known(t: Tables) -> DataFrame:
    old = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("retweet_count"),
        F.col("l_tax").alias("like_count"),
        F.col("l_discount").alias("other"),
    )
    return clean.rename_known(old, METRIC_RENAMES)


@query(
    "coerce_numbers",
    """
    SELECT p_partkey,
           TRY_CAST(CASE p_type WHEN 'ECONOMY' THEN p_name WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN NULL
                                ELSE p_size::VARCHAR END AS DOUBLE) AS v
    FROM part
    """,
)
def coerce_numbers(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    mixed = (
        F.when(kind == "ECONOMY", F.col("p_name"))
        .when(kind == "LARGE", F.concat(F.col("p_size").cast("string"), F.lit("d")))
        .when(kind != "PROMO", F.col("p_size").cast("string"))
    )
    return clean.coerce_numbers(t.part.select("p_partkey", mixed.alias("v")), ["v"])


@query(
    "relabel",
    """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'English (en)' WHEN 'tl' THEN 'Filipino (tl)'
                             WHEN 'und' THEN 'Undetermined' ELSE lang END AS lang
    FROM documents
    """,
)
def relabel(t: Tables) -> DataFrame:
    return clean.relabel(t.documents.select("doc_id", "lang"), "lang", LANGUAGE_LABELS)


@query(
    "relabel_by_table",
    """
    SELECT o_orderkey, coalesce(c.c_name, o.key) AS customer
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'none' ELSE o_custkey::VARCHAR END AS key FROM orders) o
    LEFT JOIN customer c ON o.key = c.c_custkey::VARCHAR
    """,
)
def relabel_by_table(t: Tables) -> DataFrame:
    """Keys to names by a table that grows with the data; the hot value ``none`` is not in it."""
    key = F.when(F.col("o_orderstatus") == "O", "none").otherwise(F.col("o_custkey").cast("string"))
    names = t.customer.select(F.col("c_custkey").cast("string").alias("key"), "c_name")
    return clean.relabel(t.orders.select("o_orderkey", key.alias("customer")), "customer", names)


@query(
    "flag_labels",
    """
    SELECT d.doc_id, CASE l.toxic WHEN 1 THEN 'Toxic' WHEN 0 THEN 'Not Toxic' END AS label
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def flag_labels(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left").select("doc_id", (F.col("toxic") == 1).alias("flag"))
    return clean.label_flag(joined, "flag", "Toxic", "Not Toxic", "label").select("doc_id", "label")


@query(
    "standardise_categories",
    """
    SELECT doc_id, CASE lang WHEN 'fr' THEN 'Unknown' WHEN 'de' THEN 'Unknown' ELSE lang END AS lang
    FROM documents
    """,
)
def standardise_categories(t: Tables) -> DataFrame:
    lang = F.col("lang")
    untidy = (
        F.when(lang == "fr", "\t\u00a0 \n")
        .when(lang == "en", F.concat(F.lit("\u00a0 "), lang, F.lit("\t")))
        .when(lang != "de", lang)
    )
    return clean.standardise_categories(t.documents.select("doc_id", untidy.alias("lang")), ["lang"])


@query(
    "recode_invalid",
    """
    SELECT p_partkey, CASE WHEN p_name IN ('red plate', 'small widget', 'hot ring')
                           THEN 'Unknown' ELSE p_name END AS p_name
    FROM part
    """,
)
def recode_invalid(t: Tables) -> DataFrame:
    return clean.recode(
        t.part.select("p_partkey", "p_name"), "p_name", ["red plate", "small widget", "hot ring"]
    )


@query(
    "drop_missing",
    """
    SELECT d.doc_id, d.lang, l.quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL
    """,
)
def drop_missing(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality")
    return clean.drop_missing(joined, ["quality"])


@query("positive_only", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def positive_only(t: Tables) -> DataFrame:
    return clean.positive_only(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal")


@query(
    "in_groups",
    """
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')
    """,
)
def in_groups(t: Tables) -> DataFrame:
    return clean.in_groups(
        t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "BUILDING"]
    )


@query(
    "first_per_key",
    """
    SELECT doc_id, text, lang, source, n_chars FROM (
        SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents
    ) WHERE r = 1
    """,
)
def first_per_key(t: Tables) -> DataFrame:
    return clean.first_per_key(t.documents, ["text"], ["doc_id"])
