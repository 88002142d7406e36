from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framescope.functions import sizing
from framescope.functions import tokens as tx
from framescope.functions.wordlists import ENGLISH_STOPWORDS
from framescope.operators import textstats

STOP = set(ENGLISH_STOPWORDS) | {"flood"}
TEXTS = [
    "", None, "token", "#Ñandú #a #Tag_1", "see https://x.y/#frag now", "@123 @ab1 hello @١٢٣",
    "HTTP://loud.example/path stays", "año nuevo feliz", "river the flood crest", "a1 12 123 1st 12ab 007bond",
    "mail me@home.example#tag", "@https://x.example/abc rest", "##double @@twice #@mix @#mix", "Kelvin K İstanbul",
    "line\nbreak\ttab nbsp https://a.example/b after em", "rain rain rain", "snake_case under_score",
]


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)


def counts(df):
    return {r["term"]: r["n"] for r in df.collect()}


def test_edge_texts(spark):
    df = frame(spark, TEXTS)
    got = counts(textstats.keywords(df, stopwords=STOP))
    assert got["rain"] == 3 and got["token"] == 1 and got["river"] == 1 and got["007bond"] == 1
    assert not {"the", "flood", "123", "12", "a1", "tag_1"} & set(got)
    tags = counts(textstats.hashtags(df))
    assert tags["ñandú"] == 1 and tags["tag_1"] == 1 and tags["tag"] == 1 and "a" not in tags
    pairs = counts(textstats.bigrams(df, stopwords=STOP))
    assert pairs["rain rain"] == 2 and pairs["river crest"] == 1 and pairs["nuevo feliz"] == 1
    kpis = textstats.text_kpis(df).collect()[0]
    assert kpis["rows"] == len(TEXTS) and kpis["hashtag_uses"] == sum(tags.values())
    assert kpis["unique_hashtags"] == len(tags) and kpis["numeric_mentions"] == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abTh 019#@_/:.é\n", max_size=40), max_size=30))
def test_properties_of_random_texts(spark, texts):
    df = frame(spark, [*texts, "https://" + "".join(texts[:1])])
    lists = [r["tokens"] for r in textstats.clean_tokens(df, stopwords=STOP).collect()]
    every = [w for tokens in lists for w in tokens or []]
    assert all(len(w) > 2 and w.isascii() and w.isalnum() and w == w.lower() and not w.isdigit() and w not in STOP for w in every)
    words = counts(textstats.keywords(df, stopwords=STOP))
    assert sum(words.values()) == len(every) and set(words) == set(every)
    pairs = counts(textstats.bigrams(df, stopwords=STOP))
    assert sum(pairs.values()) == sum(max(0, len(tokens or []) - 1) for tokens in lists)
    kpis = textstats.text_kpis(df).collect()[0]
    assert kpis["numeric_mentions"] == textstats.numeric_mentions(df).collect()[0][0]


def test_tokens_equal_the_single_steps(spark):
    df = frame(spark, [t for t in TEXTS if t])
    plain = tx.plain_words(tx.strip_hashtags(tx.strip_mentions(tx.strip_urls(F.col("text")))))
    both = textstats.clean_tokens(df, stopwords=()).select(
        "tokens",
        F.filter(F.split(plain, " "), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$")).alias("steps"),
    )
    assert all(r["tokens"] == r["steps"] for r in both.collect())


def test_missing_text_has_no_tokens(spark):
    assert textstats.clean_tokens(frame(spark, [None])).collect()[0]["tokens"] is None
    assert textstats.text_kpis(frame(spark, [None])).collect()[0]["hashtag_uses"] == 0
    with pytest.raises(ValueError, match="body"):
        textstats.keywords(frame(spark, ["x"]), text="body")


def test_top_terms_are_the_heads_of_the_three_counts(spark):
    texts = [t for t in TEXTS if t] + ["storm surge barrier #Storm"] * 3 + ["storm surge"] * 2
    df = frame(spark, texts)
    words, tags = counts(textstats.keywords(df, stopwords=STOP)), counts(textstats.hashtags(df))
    pairs = counts(textstats.bigrams(df, stopwords=STOP))
    got = textstats.top_terms(frame(spark, texts), stopwords=STOP, top=12).collect()
    for kind, counter, k, sign in (("keyword", words, 12, ""), ("hashtag", tags, 10, "#"), ("bigram", pairs, 10, "")):
        best = sorted(counter.items(), key=lambda item: (-item[1], item[0]))[:k]
        rows = sorted((r["rank"], r["term"], r["n"]) for r in got if r["kind"] == kind)
        assert rows == [(i + 1, sign + term, n) for i, (term, n) in enumerate(best)]


LISTED = ["alpha", "gamma", "unused", None]
LONG = [("Alpha beta gamma delta beta",), (None,), ("",), ("alpha gamma",), ("beta, alpha beta",), ("beta, alpha beta",)]


@pytest.mark.parametrize("limit", [500_000, 1])
def test_a_table_of_stop_words_is_the_same_as_a_list(spark, monkeypatch, limit):
    monkeypatch.setattr(sizing, "MAX_KEYED_ROWS", limit)
    df = spark.createDataFrame([(i, "x", t) for i, (t,) in enumerate(LONG)], "`_row` int, `my.at` string, text string").repartition(3)
    table = spark.createDataFrame([(w, 1) for w in LISTED], "word string, n int")
    plain = [w for w in LISTED if w]
    for made in (textstats.keywords, textstats.bigrams, textstats.top_terms):
        assert sorted(map(tuple, made(df, stopwords=table).collect())) == sorted(map(tuple, made(df, stopwords=plain).collect()))
    got = textstats.clean_tokens(df, stopwords=table)
    assert got.columns == ["_row", "my.at", "text", "tokens"]
    key = lambda r: r["_row"]
    assert sorted(got.collect(), key=key) == sorted(textstats.clean_tokens(df, stopwords=plain).collect(), key=key)


def test_sketches_keep_their_bounds(spark):
    words = [f"word{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100 % 10]}" for i in range(1000)]
    texts = [(" ".join(["often"] * 50 + ["second"] * 30 + words),), (None,), (" ".join(words),)]
    df = spark.createDataFrame(texts, "text string").repartition(2)
    exact = {r["term"]: r["n"] for r in textstats.keywords(df).collect()}
    for tracked in (200, 10_000):
        found = textstats.frequent_terms(df, k=2, tracked=tracked).collect()
        assert [r["term"] for r in found] == ["often", "second"] and [r["rank"] for r in found] == [1, 2]
        assert all(abs(r["n"] - exact[r["term"]]) <= r["max_error"] for r in found)
        assert (found[0]["max_error"] == 0) == (tracked == 10_000)


def test_kpis_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("no tags",)], "text string")
    assert tuple(textstats.text_kpis(df).collect()[0]) == (2, 0, 0, 0)
    assert tuple(textstats.text_kpis(df.where("false")).collect()[0]) == (0, 0, 0, 0)
