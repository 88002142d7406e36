"""The whole battery of reports over a table of posts and a table of their authors.

Each function takes a DataFrame (or a path) and returns named DataFrames; ``run`` writes all
of them. The column names are parameters with the usual names as defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import category_text
from ..functions.guards import require_columns
from ..functions.wordlists import LANGUAGE_LABELS, METRIC_RENAMES, NON_PLACE_KEYWORDS
from ..operators import clean, compare, profile, quality, temporal, textstats
from ..operators import distribution as dist
from ..sources.readers import as_frame, format_of
from ..sources.scratch import new_path
from ..sources.sinks import base_name, write_report

Reports = dict[str, DataFrame]

# Labels of the two flags, and the languages that are compared.
VERIFIED = {True: "Verified", False: "Not Verified"}
REPLY = {True: "Reply", False: "Original"}
COMPARED = ["Filipino (tl)", "English (en)"]
COMPARED_LABELS = LANGUAGE_LABELS | {"und": "other"}


@dataclass(frozen=True)
class AuthorColumns:
    key: str = "author_userName"
    created: str = "author_createdAt"
    verified: str = "author_isBlueVerified"
    location: str = "author_location"
    bio: str = "author_profile_bio_description"
    followers: str = "author_followers"
    following: str = "author_following"


@dataclass(frozen=True)
class PostColumns:
    key: str = "pseudo_id"
    text: str = "text"
    created: str = "createdAt"
    lang: str = "lang"
    reply: str = "isReply"
    reply_to: str = "pseudo_inReplyToUsername"
    verified: str = "author_isBlueVerified"
    views: str = "viewCount"
    reposts: str = "retweetCount"
    metrics: tuple[str, ...] = tuple(METRIC_RENAMES.values())


def profile_reports(df: DataFrame, counted: DataFrame | None = None) -> Reports:
    """Shape, types and missing values; ``counted`` are counts taken while the table was written."""
    return {
        "dataset_shape": profile.shape(df, counted),
        "column_names_and_dtypes": profile.schema_listing(df),
        "dtype_distribution": profile.dtype_distribution(df),
        "missing_data": profile.missing_report(df, counted=counted),
        "missing_columns": profile.missing_columns(df, counted=counted),
        "missing_summary": profile.missing_summary(df, counted=counted),
    }


def quality_reports(df: DataFrame, expected: quality.Expectations) -> Reports:
    return {
        "data_quality": quality.exception_report(df, expected),
        "data_quality_breakdown": quality.exception_breakdown(df, expected),
        "data_quality_rollup": quality.quality_rollup(df, expected),
    }


def author_expectations(c: AuthorColumns = AuthorColumns()) -> quality.Expectations:
    return quality.Expectations(
        keys=[c.key],
        types={c.created: "timestamp", c.verified: "boolean"},
        keywords={c.location: NON_PLACE_KEYWORDS},
        not_blank=[c.bio],
    )


def post_expectations(c: PostColumns = PostColumns()) -> quality.Expectations:
    return quality.Expectations(
        keys=[c.key],
        types={c.created: "timestamp", c.reply: "boolean", c.reply_to: "string", c.verified: "boolean"},
        domains={c.lang: ["tl", "en"]},
        ids=[c.reply_to],
    )


def normalise_authors(df: DataFrame, c: AuthorColumns = AuthorColumns()) -> DataFrame:
    return clean.parse_times(clean.normalise_flags(df, [c.verified]), [c.created])


def normalise_posts(df: DataFrame, c: PostColumns = PostColumns()) -> DataFrame:
    """One naming of the metrics, boolean flags, UTC times and text ids."""
    named = clean.rename_known(df, METRIC_RENAMES)
    flagged = clean.normalise_flags(named, [c.reply, c.verified])
    return clean.ids_to_text(clean.parse_times(flagged, [c.created]), [c.reply_to])


def author_reports(df: DataFrame, c: AuthorColumns = AuthorColumns()) -> Reports:
    """Distributions of the author table."""
    require_columns(df, [c.followers, c.following, c.verified, c.location])
    authors = normalise_authors(df, c)
    places = authors.select(category_text(F.col(c.location)).alias("location"))
    metrics = [c.followers, c.following]
    return {
        "author_metrics": dist.metric_profile(authors, metrics),
        "author_histograms": dist.histogram(authors, metrics),
        "author_verification": dist.labelled_counts(authors, F.col(c.verified), VERIFIED),
        "author_locations": dist.top_values_with_others(places, "location"),
    }


def engagement_reports(df: DataFrame, c: PostColumns = PostColumns()) -> Reports:
    """Distributions of the post metrics."""
    posts = normalise_posts(df, c)
    require_columns(posts, c.metrics)
    return {
        "engagement_metrics": dist.metric_profile(posts, c.metrics),
        "engagement_histograms": dist.histogram(posts, c.metrics),
    }


def categorical_reports(df: DataFrame, c: PostColumns = PostColumns()) -> Reports:
    """Reply status, languages and verification of the posts."""
    require_columns(df, [c.reply, c.lang, c.verified])
    posts = clean.relabel(normalise_posts(df, c), c.lang, LANGUAGE_LABELS)
    return {
        "reply_status": dist.labelled_counts(posts, F.col(c.reply), REPLY),
        "top_languages": dist.top_values(posts, c.lang),
        "post_verification": dist.labelled_counts(posts, F.col(c.verified), VERIFIED),
    }


def temporal_reports(
    df: DataFrame, freq: str = "D", top: int = temporal.TOP_SERIES, c: PostColumns = PostColumns()
) -> Reports:
    """Post volume over time by language."""
    require_columns(df, [c.created, c.lang])
    posts = normalise_posts(df, c)
    return {
        "temporal_volume": temporal.stacked_bounds(posts, c.created, c.lang, freq, top, labels=LANGUAGE_LABELS),
        "temporal_totals": temporal.period_totals(posts, c.created, freq),
        "temporal_peaks": temporal.peak_periods(posts, c.created, freq),
    }


def text_reports(df: DataFrame, top: int = textstats.TOP_KEYWORDS, c: PostColumns = PostColumns()) -> Reports:
    """Keywords, hashtags, bigrams and mentions of the posts."""
    require_columns(df, [c.text])
    return {"text_kpis": textstats.text_kpis(df, c.text), "top_terms": textstats.top_terms(df, c.text, top=top)}


def bivariate_reports(df: DataFrame, c: PostColumns = PostColumns()) -> Reports:
    """Traits of author and post against engagement."""
    normalised = normalise_posts(df, c)
    require_columns(normalised, [c.verified, c.reply, c.lang, c.views, c.reposts])
    posts = clean.relabel(normalised, c.lang, COMPARED_LABELS)
    posts = clean.label_flag(posts, c.verified, VERIFIED[True], VERIFIED[False], "verify_label")
    posts = clean.label_flag(posts, c.reply, REPLY[True], REPLY[False], "reply_label")
    parts = [REPLY[False], REPLY[True]]
    traits = {"Verification": "verify_label", "Language": c.lang, "Reply Status": "reply_label"}
    limits = {"Language": COMPARED}
    return {
        "headline": compare.headline(
            posts,
            {
                "verified": F.col(c.verified),
                "original": ~F.col(c.reply),
                COMPARED[0]: F.col(c.lang) == COMPARED[0],
            },
        ),
        "views_by_verification": compare.metric_by_group(posts, c.views, "verify_label"),
        "engagement_by_language": compare.metric_means_by_group(posts, [c.views, c.reposts], c.lang, COMPARED),
        "reply_mix_by_language": compare.composition_bounds(
            compare.composition(posts, c.lang, "reply_label", parts, COMPARED, metric=c.views)
        ),
        "trait_means": compare.trait_means(posts, traits, c.views, limits),
        "trait_lift": compare.trait_lift(posts, traits, c.views, limits),
    }


def all_author_reports(
    df: DataFrame, c: AuthorColumns = AuthorColumns(), counted: DataFrame | None = None
) -> Reports:
    return profile_reports(df, counted) | quality_reports(df, author_expectations(c)) | author_reports(df, c)


def all_post_reports(
    df: DataFrame, c: PostColumns = PostColumns(), counted: DataFrame | None = None
) -> Reports:
    return (
        profile_reports(df, counted)
        | quality_reports(df, post_expectations(c))
        | engagement_reports(df, c)
        | categorical_reports(df, c)
        | temporal_reports(df, c=c)
        | text_reports(df, c=c)
        | bivariate_reports(df, c)
    )


def run(
    spark: SparkSession,
    authors: str | DataFrame,
    posts: str | DataFrame,
    out: str,
    fmt: str = "parquet",
    infer: bool = False,
    multi_line: bool = True,
) -> list[str]:
    """Write every report of both tables to ``out`` and return the paths.

    A CSV file is parsed once: the reports read a Parquet copy in the shared folder, and the counts
    of rows and missing values are taken while that is written. With
    ``infer`` its columns get types, which the type reports then show; without ``multi_line``
    the file can be split (``read_csv``).
    """
    written = []
    for name, source, reports in (("authors", authors, all_author_reports), ("posts", posts, all_post_reports)):
        base = base_name(source) if isinstance(source, str) else name
        frame, counted = as_frame(spark, source, infer=infer, multi_line=multi_line), None
        if isinstance(source, str) and format_of(source) == "csv":
            copy = new_path(spark, base)
            watched, observation = profile.counting(frame)
            watched.write.parquet(copy)
            counted = profile.observed_counts(frame, observation)
            frame = spark.read.parquet(copy)
        for report, result in reports(frame, counted=counted).items():
            written.append(write_report(result, out, base, report, fmt))
    return written
