"""Registered queries of this subpackage, each over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, importance, jaccard, langid, lines, lm, packing, pii, ranked, suffix, tokencounts, warc
from .text import bucket_of, prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors["vec_id"] % 50 == 0, k=5)


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = bucket_of(documents["doc_id"], 5) == 0
    model = langid.fit(documents.where(~held_out).select("doc_id", "text", "lang"))
    return langid.predict(documents, model, keep=[documents["doc_id"], held_out.alias("held_out")])


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


@query
def op7_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_pages(table(spark, folder, "pages"))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return packing.pack(packing.pieces(documents, tokenizer("word_bpe_49k.json")))


@query
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    deduped = lines.dedup_lines(table(spark, folder, "documents"))
    return deduped.select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query
def op10_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents"))


@query
def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix.dedup_strings(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    scored = lm.scores(documents, bucket_of(documents["doc_id"], 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# The CRC-32 of a word: a table by the rule of the polynomial, then one step per byte.
CRC_SQL = """
    WITH crc AS (
        SELECT list_transform(range(256), lambda b: list_reduce(range(8)::BIGINT[],
            lambda a, i: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b::BIGINT)) AS steps
    )"""


@query
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLES["op11_importance_resampling"] = rf"""
    {CRC_SQL.strip()},
    d AS (SELECT row_number() OVER () AS r, doc_id,
              coalesce(regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
    b AS (SELECT coalesce(regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM benchmark),
    dw AS (SELECT r, unnest(words) AS word FROM d),
    bw AS (SELECT unnest(words) AS word FROM b),
    words AS (SELECT word, hex(encode(word)) AS code FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
    hashed AS (
        SELECT word, xor(list_reduce(
            list_transform(range(length(code) // 2), lambda i: ('0x' || substring(code, (2 * i + 1)::BIGINT, 2))::BIGINT),
            lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
        FROM words, crc
    ),
    s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY 1),
    t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY 1),
    gains AS (
        SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000))
            / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
        FROM s FULL JOIN t USING (bucket)
    ),
    weighed AS (
        SELECT d.r, any_value(doc_id) AS doc_id, count(word) AS n_features,
               coalesce(floor(sum(gain)::DOUBLE / count(word)), 0)::BIGINT AS weight
        FROM d LEFT JOIN dw ON d.r = dw.r LEFT JOIN hashed USING (word) LEFT JOIN gains USING (bucket) GROUP BY 1
    ),
    scored AS (
        SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
            + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM weighed
    ),
    drawn AS (
        SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n
        FROM scored WHERE n_features >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank, n_features AS n_words
    FROM scored LEFT JOIN drawn USING (r)
"""

ORACLES["op12_ranked_search"] = rf"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id,
               unnest(regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ),
    i AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ),
    a AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS terms FROM d),
    n AS (SELECT r, count(*) AS n FROM d GROUP BY 1),
    tf AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY r, term),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, a GROUP BY term, n_docs),
    scored AS (
        SELECT item_id, r, any_value(doc_id) AS doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // terms))))::BIGINT AS score
        FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r), a GROUP BY item_id, r
    )
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES["op7_warc_archives"] = """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
    FROM f
"""
