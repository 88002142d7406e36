"""Word, hashtag, bigram and mention statistics of a text column."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as tx
from ..functions.guards import by_name, quoted, require_columns
from ..functions.periods import period_start
from ..functions.sizing import keyed_table
from ..functions.wordlists import ENGLISH_STOPWORDS, FILIPINO_STOPWORDS, TOPIC_NOISE

DEFAULT_STOPWORDS = frozenset(ENGLISH_STOPWORDS) | frozenset(FILIPINO_STOPWORDS) | frozenset(TOPIC_NOISE)

# A list of stop words: in the plan, or a table whose first column has them in lower case.
Stopwords = Iterable[str] | DataFrame

# List lengths of the text report.
TOP_KEYWORDS = 15
TOP_SUBLISTS = 10


def _count(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _without_listed(words: DataFrame, column: str, stopwords: DataFrame) -> DataFrame:
    """The rows whose word is not in the table; NULL stays. The table is broadcast by a check of its size."""
    listed, small = keyed_table(stopwords.select(F.col(quoted(stopwords.columns[0])).alias("_stop")).where("_stop IS NOT NULL").distinct())
    return words.join(F.broadcast(listed) if small else listed, words[column] == listed["_stop"], "left_anti")


def _tokens_by_table(df: DataFrame, text: str, stopwords: DataFrame, into: str) -> DataFrame:
    """:func:`clean_tokens` for a table of stop words.

    Each word becomes a row with its place, the listed ones fall away in a join, and the rest is
    put together again in order. The row itself travels once, beside a place of its own.
    """
    row = F.struct(*[by_name(df, name).alias(name) for name in df.columns])
    words = F.transform(tx.candidates(F.col("_bare")), lambda word: F.lower(word))
    bare = df.select(F.monotonically_increasing_id().alias("_row"), row.alias("_all"), tx.without_marks(by_name(df, text)).alias("_bare"))
    nothing = F.lit(None)
    head = F.array(F.struct(F.lit(-1).alias("at"), nothing.cast("string").alias("word"), F.col("_all").alias("row"), F.col("_bare").isNull().alias("missing")))
    empty = nothing.cast(bare.schema["_all"].dataType)
    tail = F.transform(words, lambda word, at: F.struct(at.alias("at"), word.alias("word"), empty.alias("row"), nothing.cast("boolean").alias("missing")))
    listed = bare.select("_row", F.explode(F.concat(head, F.coalesce(tail, F.slice(head, 1, 0)))).alias("w"))
    places = listed.select("_row", "w.at", F.col("w.word").alias("_word"), "w.row", "w.missing")
    kept = _without_listed(places, "_word", stopwords)
    found = kept.groupBy("_row").agg(
        F.first("row", ignorenulls=True).alias("_all"),
        F.first("missing", ignorenulls=True).alias("_missing"),
        F.array_sort(F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("at", "_word")))).alias("_words"),
    )
    tokens = F.when(~F.col("_missing"), F.transform("_words", lambda w: w["_word"]))
    fields = [F.col("_all").getField(name).alias(name) for name in df.columns if name != into]
    return found.select(*fields, tokens.alias(into))


def clean_tokens(
    df: DataFrame, text: str = "text", stopwords: Stopwords = DEFAULT_STOPWORDS, into: str = "tokens"
) -> DataFrame:
    """Add the ordered keywords of each text as an array.

    A short list of stop words stands in the plan. A long one is a table (its first column, in
    lower case): it is joined, on a checked size by broadcast, and every text is put together again.
    """
    require_columns(df, [text])
    if isinstance(stopwords, DataFrame):
        return _tokens_by_table(df, text, stopwords, into)
    # The text without marks is a column of its own so that it is computed once per row.
    bare = df.withColumn("_bare", tx.without_marks(by_name(df, text)))
    return bare.withColumn(into, tx.keyword_tokens(F.col("_bare"), stopwords)).drop("_bare")


# In the operators below the expression stands inside `explode` or `inline`. Exploding a
# column that a projection computed makes Spark filter on that column first, which repeats
# the costly expression.


def keywords(
    df: DataFrame, text: str = "text", stopwords: Stopwords = DEFAULT_STOPWORDS
) -> DataFrame:
    """``(term, n)`` over all texts.

    A table of stop words is joined to the counted terms, one row per distinct word.

    The stop words are tested after the explode, in generated code, and the words are counted
    in each task before the shuffle, so a very frequent word is no hot key.
    """
    require_columns(df, [text])
    bare = df.select(tx.without_marks(by_name(df, text)).alias("_bare"))
    words = bare.select(F.explode(tx.candidates(F.col("_bare"))).alias("_word"))
    terms = words.select(F.lower("_word").alias("term"))
    if isinstance(stopwords, DataFrame):
        return _without_listed(_count(terms), "term", stopwords)
    return _count(terms.where(~tx.is_stopword(F.col("term"), stopwords)))


def hashtags(df: DataFrame, text: str = "text") -> DataFrame:
    """``(term, n)`` of the hashtags in the raw texts, without the ``#``."""
    require_columns(df, [text])
    return _count(df.select(F.explode(tx.hashtags(by_name(df, text))).alias("term")))


def bigrams(
    df: DataFrame, text: str = "text", stopwords: Stopwords = DEFAULT_STOPWORDS
) -> DataFrame:
    """``(term, n)`` of adjacent keywords within a text."""
    tokens = clean_tokens(df.select(by_name(df, text)), text, stopwords, into="_tokens")
    pairs = tokens.select(F.inline(tx.adjacent(F.col("_tokens"))).alias("first", "second"))
    counted = pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.concat_ws(" ", "first", "second").alias("term"), "n")


def numeric_mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """``(numeric_mentions)``: mentions made of digits only, over all texts."""
    require_columns(df, [text])
    return df.agg(
        F.coalesce(F.sum(tx.numeric_mentions(by_name(df, text)).cast("bigint")), F.lit(0)).alias("numeric_mentions")
    )


def text_kpis(df: DataFrame, text: str = "text") -> DataFrame:
    """``(rows, hashtag_uses, unique_hashtags, numeric_mentions)``; rows without text count.

    One scan: each text gives its hashtags and one row without a tag that holds its mentions.
    """
    require_columns(df, [text])
    none = F.array().cast("array<string>")
    listed = df.select(
        F.coalesce(tx.hashtags(by_name(df, text)), none).alias("_tags"),
        F.coalesce(tx.numeric_mentions(by_name(df, text)), F.lit(0)).cast("bigint").alias("_mentions"),
    )
    tags = F.transform("_tags", lambda tag: F.struct(tag.alias("tag"), F.lit(0).cast("bigint").alias("mentions")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("tag"), F.col("_mentions").alias("mentions")))
    per_tag = listed.select(F.inline(F.concat(own, tags))).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("mentions").alias("mentions"))
    return per_tag.agg(
        F.coalesce(F.sum(F.when(F.col("tag").isNull(), F.col("n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("tag").isNotNull(), F.col("n"))), F.lit(0)).alias("hashtag_uses"),
        F.count("tag").alias("unique_hashtags"),
        F.coalesce(F.sum("mentions"), F.lit(0)).alias("numeric_mentions"),
    )


def hashtag_sketches(df: DataFrame, ts: str, text: str = "text", freq: str = "D", log_size: int = 12) -> DataFrame:
    """``(period, hashtag_uses, sketch)``: a mergeable sketch of the distinct hashtags of each period."""
    require_columns(df, [ts, text])
    used = df.where(by_name(df, ts).isNotNull()).select(period_start(by_name(df, ts), freq).alias("period"), F.explode(tx.hashtags(by_name(df, text))).alias("_tag"))
    return used.groupBy("period").agg(
        F.count(F.lit(1)).alias("hashtag_uses"), F.hll_sketch_agg("_tag", F.lit(log_size)).alias("sketch")
    )


def unique_hashtags(sketches: DataFrame, by: Iterable[str] = (), log_size: int = 12) -> DataFrame:
    """``(…, hashtag_uses, unique_hashtags, low, high)`` of merged sketches.

    ``low`` and ``high`` are three relative standard errors (1.04 / sqrt of the registers) away.
    """
    merged = sketches.groupBy(*by).agg(F.sum("hashtag_uses").alias("hashtag_uses"), F.hll_union_agg("sketch").alias("_sketch"))
    error = 3 * 1.04 / math.sqrt(1 << log_size)
    found = merged.withColumn("unique_hashtags", F.hll_sketch_estimate("_sketch"))
    estimate = F.col("unique_hashtags")
    return found.select(
        *by, "hashtag_uses", "unique_hashtags",
        F.floor(estimate / (1 + error)).alias("low"), F.ceil(estimate / (1 - error)).alias("high"),
    )


def frequent_terms(
    df: DataFrame, text: str = "text", stopwords: Iterable[str] = DEFAULT_STOPWORDS, k: int = TOP_KEYWORDS, tracked: int = 10_000
) -> DataFrame:
    """``(rank, term, n, max_error)``: the ``k`` most frequent keywords from a sketch of ``tracked`` terms.

    No word is shuffled: each task sends its sketch. A count is wrong by at most ``max_error``, 3.5 / ``tracked`` of
    all keywords (0 where the sketch holds every term), so a term whose count is further from the last rank is never missed.
    """
    require_columns(df, [text])
    bare = df.select(tx.without_marks(by_name(df, text)).alias("_bare"))
    words = bare.select(F.explode(tx.candidates(F.col("_bare"))).alias("_word")).select(F.lower("_word").alias("_word"))
    kept = words.where(~tx.is_stopword(F.col("_word"), stopwords))
    size = 1 << math.ceil(math.log2(tracked / 0.75))
    top = F.call_function("approx_top_k", F.col("_word"), F.lit(k), F.lit(tracked))
    found = kept.agg(top.alias("_top"), F.count(F.lit(1)).alias("_all"), F.approx_count_distinct("_word").alias("_terms"))
    error = F.when(F.col("_terms") * 1.2 < tracked, F.lit(0)).otherwise(F.ceil(F.col("_all") * F.lit(3.5 / size)))
    listed = found.select(F.posexplode("_top").alias("_at", "_item"), error.cast("bigint").alias("max_error"))
    return listed.select((F.col("_at") + 1).alias("rank"), F.col("_item.item").alias("term"), F.col("_item.count").alias("n"), "max_error")


def ranked(counts: DataFrame, k: int) -> DataFrame:
    """``(rank, term, n)``: the ``k`` most frequent terms; equal counts are ordered by term."""
    best = counts.orderBy(F.desc("n"), F.asc("term")).limit(k)
    # One task numbers at most k rows.
    return best.select(
        F.row_number().over(Window.orderBy(F.desc("n"), F.asc("term"))).alias("rank"), "term", "n"
    )


def top_terms(
    df: DataFrame,
    text: str = "text",
    stopwords: Stopwords = DEFAULT_STOPWORDS,
    top: int = TOP_KEYWORDS,
) -> DataFrame:
    """``(kind, rank, term, n)``: top keywords, hashtags and bigrams from one scan.

    Every keyword is counted together with the keyword that follows it (none after the last
    one); hashtags are appended with their ``#`` and no follower. Pairs are the bigrams, and
    summed over the follower they are the single terms, so the words are exploded and
    shuffled once for all three lists.
    """
    tokens = clean_tokens(df.select(by_name(df, text)), text, stopwords, into="_tokens")
    words = F.coalesce("_tokens", F.array().cast("array<string>"))
    tags = F.coalesce(tx.hashtags(F.col(quoted(text))), F.array().cast("array<string>"))
    listed = tokens.select(
        words.alias("_words"),
        F.concat(words, F.transform(tags, lambda tag: F.concat(F.lit("#"), tag))).alias("_all"),
    )
    followers = F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0)))
    pairs = listed.select(F.inline(F.arrays_zip("_all", followers)).alias("first", "second"))
    counts = pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    singles = counts.groupBy(F.col("first").alias("term")).agg(F.sum("n").alias("n"))
    is_tag = F.col("term").startswith("#")

    def best(kind: str, terms: DataFrame, wanted: Column, k: int) -> DataFrame:
        # The test is made on the count, so the three branches keep sharing their shuffles.
        known = terms.where(F.when(wanted, F.col("n")) > 0)
        return ranked(known, k).select(F.lit(kind).alias("kind"), "rank", "term", "n")

    joined = counts.select("second", F.concat_ws(" ", "first", "second").alias("term"), "n")
    sub = min(TOP_SUBLISTS, top)
    return (
        best("keyword", singles, ~is_tag, top)
        .unionByName(best("hashtag", singles, is_tag, sub))
        .unionByName(best("bigram", joined, F.col("second").isNotNull(), sub))
    )
