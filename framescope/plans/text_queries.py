"""Text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import textstats
from ..sources.readers import spread
from .catalog import Tables, query, sql_list

# Patterns of the SQL, written apart from those of the operators.
WORD = r"[\p{L}\p{N}_]+"
URL = r"http(?:s)?://[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"

# The raw documents have no tags, mentions of digits or web addresses, so a tail with all
# of them, made of the row's own values, is added to each whole text.
POSTS_SQL = """
    SELECT doc_id, concat(text, ' #', source, ' #', lang, ' @', doc_id::VARCHAR, ' @', source,
                          ' https://x.example/', lang, '#part', lang, ' #a ', '@', n_chars::VARCHAR) AS text
    FROM documents
"""


def posts(t: Tables) -> DataFrame:
    d = spread(t.documents, to_cores=True)
    text = F.concat(
        d.text, F.lit(" #"), d.source, F.lit(" #"), d.lang, F.lit(" @"), d.doc_id.cast("string"),
        F.lit(" @"), d.source, F.lit(" https://x.example/"), d.lang, F.lit("#part"), d.lang,
        F.lit(" #a "), F.lit("@"), d.n_chars.cast("string"),
    )
    return d.select("doc_id", text.alias("text"))


STOP = sql_list(sorted(textstats.DEFAULT_STOPWORDS))


def _tokens_sql(source: str) -> str:
    """One row per text with its keywords in order."""
    return f"""
    SELECT doc_id, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(
               regexp_replace(text, '{URL}', ' ', 'g'), '@{WORD}', ' ', 'g'), '#{WORD}', ' ', 'g'),
               '[^0-9A-Za-z]+', ' ', 'g')), ' '),
               lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({STOP})) AS tokens
    FROM ({source})
    """


def _keywords_sql(source: str) -> str:
    return f"""
    SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM ({_tokens_sql(source)})) GROUP BY 1
    """


def _hashtags_sql(source: str) -> str:
    return f"""
    SELECT term, count(*) AS n FROM (
        SELECT lower(tag) AS term FROM (
            SELECT unnest(regexp_extract_all(text, '#({WORD})', 1)) AS tag FROM ({source})
        ) WHERE length(tag) > 1
    ) GROUP BY 1
    """


def _bigrams_sql(source: str) -> str:
    return f"""
    SELECT term, count(*) AS n FROM (
        SELECT tokens[i] || ' ' || tokens[i + 1] AS term
        FROM (SELECT tokens, unnest(range(1, len(tokens))) AS i FROM ({_tokens_sql(source)}))
    ) GROUP BY 1
    """


def _mentions_sql(source: str) -> str:
    return f"""
    SELECT count(*) FILTER (regexp_matches(m, '^\\p{{Nd}}+$')) AS numeric_mentions
    FROM (SELECT unnest(regexp_extract_all(text, '@({WORD})', 1)) AS m FROM ({source}))
    """


@query(
    "clean_tokens",
    f"""
    SELECT doc_id, len(tokens)::INT AS n_tokens, array_to_string(tokens, ' ') AS tokens
    FROM ({_tokens_sql(POSTS_SQL)})
    """,
)
def clean_tokens(t: Tables) -> DataFrame:
    tokens = textstats.clean_tokens(posts(t))
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query("keywords", _keywords_sql("SELECT doc_id, text FROM documents"))
def keywords(t: Tables) -> DataFrame:
    return textstats.keywords(spread(t.documents, to_cores=True))


@query("hashtags", _hashtags_sql(POSTS_SQL))
def hashtags(t: Tables) -> DataFrame:
    return textstats.hashtags(posts(t))


@query("bigrams", _bigrams_sql("SELECT doc_id, text FROM documents"))
def bigrams(t: Tables) -> DataFrame:
    return textstats.bigrams(spread(t.documents, to_cores=True))


@query("numeric_mentions", _mentions_sql(POSTS_SQL))
def numeric_mentions(t: Tables) -> DataFrame:
    return textstats.numeric_mentions(posts(t))


@query(
    "text_kpis",
    f"""
    SELECT (SELECT count(*) FROM documents) AS rows,
           (SELECT sum(n)::BIGINT FROM ({_hashtags_sql(POSTS_SQL)})) AS hashtag_uses,
           (SELECT count(*) FROM ({_hashtags_sql(POSTS_SQL)})) AS unique_hashtags,
           (SELECT numeric_mentions FROM ({_mentions_sql(POSTS_SQL)})) AS numeric_mentions
    """,
)
def text_kpis(t: Tables) -> DataFrame:
    return textstats.text_kpis(posts(t))


@query(
    "ranked_keywords",
    f"""
    SELECT row_number() OVER (ORDER BY n DESC, term)::INT AS rank, term, n
    FROM ({_keywords_sql("SELECT conv_id AS doc_id, text FROM conversations")})
    QUALIFY rank <= 15
    """,
)
def ranked_keywords(t: Tables) -> DataFrame:
    return textstats.ranked(textstats.keywords(spread(t.conversations, to_cores=True)), textstats.TOP_KEYWORDS)


@query(
    "top_terms",
    f"""
    WITH u AS (
        SELECT 'keyword' AS kind, term, n FROM ({_keywords_sql(POSTS_SQL)})
        UNION ALL SELECT 'hashtag', '#' || term, n FROM ({_hashtags_sql(POSTS_SQL)})
        UNION ALL SELECT 'bigram', term, n FROM ({_bigrams_sql(POSTS_SQL)})
    )
    SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY n DESC, term)::INT AS rank, term, n
    FROM u QUALIFY rank <= CASE kind WHEN 'keyword' THEN 15 ELSE 10 END
    """,
)
def top_terms(t: Tables) -> DataFrame:
    return textstats.top_terms(posts(t))


# A long stop list: every word of the conversations, as a table.
LISTED_SQL = """
    SELECT DISTINCT unnest(string_split(lower(regexp_replace(text, '[^0-9A-Za-z]+', ' ', 'g')), ' ')) AS word FROM conversations
"""


def listed_words(t: Tables) -> DataFrame:
    words = F.split(F.lower(F.regexp_replace("text", "[^0-9A-Za-z]+", " ")), " ")
    return t.conversations.select(F.explode(words).alias("word")).distinct()


def _unlisted_sql(source: str) -> str:
    """Keywords in order as rows, without those of the long list."""
    plain = _tokens_sql(source).replace(f" AND w NOT IN ({STOP})", "")
    return f"""
    SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS at
    FROM (SELECT doc_id, tokens[i] AS word, i FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM ({plain})))
    WHERE word NOT IN (SELECT word FROM ({LISTED_SQL}) WHERE word IS NOT NULL)
    """


@query(
    "keywords_by_table",
    f"SELECT word AS term, count(*) AS n FROM ({_unlisted_sql('SELECT doc_id, text FROM documents')}) GROUP BY 1",
)
def keywords_by_table(t: Tables) -> DataFrame:
    return textstats.keywords(spread(t.documents, to_cores=True), stopwords=listed_words(t))


@query(
    "bigrams_by_table",
    f"""
    WITH w AS ({_unlisted_sql('SELECT doc_id, text FROM documents')})
    SELECT a.word || ' ' || b.word AS term, count(*) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.at = a.at + 1 GROUP BY 1
    """,
)
def bigrams_by_table(t: Tables) -> DataFrame:
    return textstats.bigrams(spread(t.documents, to_cores=True), stopwords=listed_words(t))


@query(
    "frequent_terms",
    f"SELECT least(15, count(*)) AS reported, least(15, count(*)) AS within, 0::BIGINT AS missed FROM ({_keywords_sql('SELECT doc_id, text FROM documents')})",
)
def frequent_terms(t: Tables) -> DataFrame:
    """Sketched terms held against exact counts: how many are within their bound, and which should be listed."""
    exact = textstats.keywords(spread(t.documents, to_cores=True)).withColumnRenamed("n", "exact")
    found = textstats.frequent_terms(spread(t.documents, to_cores=True)).select("term", "n", "max_error")
    both = exact.join(found, "term", "left")
    last = found.agg(F.struct(F.min("n").alias("n"), F.max("max_error").alias("e"))).scalar()
    return both.agg(
        F.count("n").alias("reported"),
        F.count_if(F.abs(F.col("n") - F.col("exact")) <= F.col("max_error")).alias("within"),
        F.count_if(F.col("n").isNull() & (F.col("exact") > last["n"] + last["e"])).alias("missed"),
    )


TAGGED_SQL = "SELECT ts, concat('#', event_type, ' #user', user_id::VARCHAR, ' #e', event_id::VARCHAR) AS text FROM events"


@query(
    "unique_hashtags",
    f"""
    WITH tags AS (SELECT date_trunc('week', ts)::TIMESTAMP AS period, unnest(regexp_extract_all(text, '#({WORD})', 1)) AS tag FROM ({TAGGED_SQL}))
    SELECT period, count(*) AS hashtag_uses, count(DISTINCT tag) AS exact, true AS covered FROM tags GROUP BY 1
    UNION ALL SELECT NULL, count(*), count(DISTINCT tag), true FROM tags
    """,
)
def unique_hashtags(t: Tables) -> DataFrame:
    """Sketches of weeks, and of all of them merged, held against exact distinct counts."""
    text = F.concat(F.lit("#"), "event_type", F.lit(" #user"), F.col("user_id").cast("string"), F.lit(" #e"), F.col("event_id").cast("string"))
    tagged = t.events.select("ts", text.alias("text"))
    sketches = textstats.hashtag_sketches(tagged, "ts", freq="W")
    period = F.date_trunc("week", "ts").cast("timestamp_ntz").alias("period")
    tags = tagged.select(period, F.explode(F.split("text", " ")).alias("tag"))
    weeks = textstats.unique_hashtags(sketches, ["period"]).join(tags.groupBy("period").agg(F.count_distinct("tag").alias("exact")), "period")
    whole = textstats.unique_hashtags(sketches).withColumns(
        {"period": F.lit(None).cast("timestamp_ntz"), "exact": tags.agg(F.count_distinct("tag")).scalar()}
    )
    covered = F.col("exact").between(F.col("low"), F.col("high"))
    return weeks.unionByName(whole).select("period", "hashtag_uses", "exact", covered.alias("covered"))
