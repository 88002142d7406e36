"""Text expressions: stripping, tokens, hashtags, bigrams and mentions.

Only native functions are used. The character classes are spelled out because the
shorthand classes of regular expressions differ between engines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns. A word character is a letter, a number or an underscore of any
# script; white space includes the Unicode spaces.
WORD = r"[\p{L}\p{N}_]+"
NOT_SPACE = (
    r"[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
URL = "https?://" + NOT_SPACE
MENTION = "@" + WORD
HASHTAG = "#" + WORD
NOT_ALNUM = "[^a-zA-Z0-9]+"
DIGITS = r"^\p{Nd}+$"

# Shortest keyword and shortest hashtag.
MIN_KEYWORD = 3
MIN_HASHTAG = 2

# A run of ASCII letters and digits that is long enough and has a letter: what is left of
# the plain words once short words and numbers are dropped.
CANDIDATE = f"(?=[a-zA-Z0-9]{{{MIN_KEYWORD}}})[0-9]*[a-zA-Z][a-zA-Z0-9]*"


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION, " ")


def strip_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, HASHTAG, " ")


def plain_words(text: Column) -> Column:
    """Lower-case ASCII letters and digits, separated by single spaces."""
    return F.lower(F.regexp_replace(text, NOT_ALNUM, " "))


def without_marks(text: Column) -> Column:
    """Text without URLs, mentions and hashtags.

    URLs go first because they may contain the other two. A mention and a hashtag cannot
    overlap, so one pass removes both. Each pass runs only on texts that contain its sign,
    which a plain search finds at a fraction of the cost of the pattern.
    """
    kept = F.when(text.contains("://"), strip_urls(text)).otherwise(text)
    marked = kept.contains("@") | kept.contains("#")
    return F.when(marked, F.regexp_replace(kept, "[@#]" + WORD, " ")).otherwise(kept)


def candidates(bare: Column) -> Column:
    """The words of a text without marks that may be keywords, in order, case kept."""
    return F.regexp_extract_all(bare, F.lit(CANDIDATE), 0)


def is_stopword(word: Column, stopwords: Iterable[str]) -> Column:
    """Whether a lower-case word is in the list, which becomes a hash set in the plan."""
    words = sorted(set(stopwords))
    return word.isin(*words) if words else F.lit(False)


def keyword_tokens(bare: Column, stopwords: Iterable[str] = ()) -> Column:
    """The keywords of a text without marks in order, repeats kept; NULL for a missing text."""
    words = F.transform(candidates(bare), lambda word: F.lower(word))
    return F.filter(words, lambda word: ~is_stopword(word, stopwords))


def hashtags(text: Column) -> Column:
    """Lower-case hashtags of the raw text (fragments of URLs count), repeats kept."""
    found = F.regexp_extract_all(text, F.lit(f"#({WORD})"), 1)
    return F.transform(
        F.filter(found, lambda tag: F.length(tag) >= MIN_HASHTAG), lambda tag: F.lower(tag)
    )


def adjacent(tokens: Column) -> Column:
    """Adjacent pairs of a token array as ``(first, second)``; NULL where there is no pair."""
    size = F.size(tokens)
    return F.when(
        size >= 2,
        F.arrays_zip(
            F.slice(tokens, 1, size - 1).alias("first"), F.slice(tokens, 2, size - 1).alias("second")
        ),
    )


def numeric_mentions(text: Column) -> Column:
    """How many mentions of a text consist of digits only."""
    found = F.regexp_extract_all(text, F.lit(f"@({WORD})"), 1)
    return F.size(F.filter(found, lambda name: name.rlike(DIGITS)))
