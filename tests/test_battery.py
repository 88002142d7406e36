from __future__ import annotations

import pytest

from framescope.plans import battery

from .test_plans import records_read

AUTHORS = """author_userName,author_createdAt,author_isBlueVerified,author_location,author_profile_bio_description,author_followers,author_following
ann,2020-01-01T00:00:00Z,True,Manila,writer,100,5
bob,2021-02-03T00:00:00Z,false,Manila,,2000,0
cat,not a date,1,Earth & moon, ,0,7
ann,2020-01-01T00:00:00Z,True,,writer,100,5
"""
POSTS = """pseudo_id,text,createdAt,lang,isReply,pseudo_inReplyToUsername,author_isBlueVerified,retweet_count,reply_count,like_count,quote_count,view_count,bookmark_count
1,"Storm surge #Storm @123",2025-09-21 10:00:00+00:00,tl,False,,True,0,1,2,0,100,0
2,"Storm surge again, https://t.example/#x",2025-09-21 23:00:00+00:00,tl,True,77.0,no,3,0,0,0,300,0
3,"dikes failed",2025-09-22 01:00:00+08:00,en,False,,True,0,0,9,0,1000,0
4,NA,2025-09-23,und,True,78.0,False,0,0,0,0,0,0
4,again,bad time,en,False,,False,1,1,1,0,50,0
"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("battery")
    (folder / "authors.csv").write_text(AUTHORS)
    (folder / "posts.csv").write_text(POSTS)
    return folder


def table(spark, path):
    return [tuple(r) for r in spark.read.parquet(path).collect()]


def test_battery_writes_every_report(spark, files):
    out = str(files / "out")
    written = battery.run(spark, str(files / "authors.csv"), str(files / "posts.csv"), out)
    assert len(written) == len(set(written)) == 13 + 25
    assert table(spark, f"{out}/posts_dataset_shape") == [(5, 13)]
    assert {r[:2] for r in table(spark, f"{out}/authors_author_locations")} == {("Manila", 2), ("Others", 2)}
    findings = {(r[0], r[1], r[3]) for r in table(spark, f"{out}/authors_data_quality")}
    assert findings == {
        ("Duplicate Rows", "author_userName", 1), ("Wrong Data Types", "author_createdAt", 1),
        ("Wrong Data Types", "author_isBlueVerified", 0), ("Inconsistent Values", "author_location", 1),
        ("Inconsistent Values", "author_profile_bio_description", 1),
    }
    assert table(spark, f"{out}/authors_data_quality_rollup") == [(1, 4, 4, 7)]
    lift = {r[0]: r[1:] for r in table(spark, f"{out}/posts_trait_lift")}
    assert lift["Language"] == (200.0, 525.0, 2.625)
    assert lift["Verification"] == (175.0, 550.0, pytest.approx(550 / 175))
    headline = {r[0]: r[1] for r in table(spark, f"{out}/posts_headline")}
    assert headline == {"rows": 5, "verified": 2, "original": 3, "Filipino (tl)": 2}
    assert table(spark, f"{out}/posts_text_kpis") == [(5, 1, 1, 1)]
    days = {(str(r[0])[:10], r[1]): r[3] for r in table(spark, f"{out}/posts_temporal_volume")}
    # 01:00 at +08:00 is still the day before in UTC.
    assert days == {
        ("2025-09-21", "Filipino (tl)"): 2, ("2025-09-21", "English (en)"): 1,
        ("2025-09-23", "Other"): 1,
    }
    reply = {r[1]: r[2] for r in table(spark, f"{out}/posts_reply_status")}
    assert reply == {"Original": 3, "Reply": 2}


def test_battery_with_inferred_types(spark, files):
    out = str(files / "typed")
    battery.run(spark, str(files / "authors.csv"), str(files / "posts.csv"), out, infer=True)
    listing = [tuple(map(str, r)) for r in table(spark, f"{out}/authors_column_names_and_dtypes")]
    types = {name: row for row in listing for name in row}
    assert "int" in str(types["author_followers"]) and "string" in types["author_userName"]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([], "text string")
    with pytest.raises(ValueError, match="createdAt"):
        battery.temporal_reports(df)
    with pytest.raises(ValueError, match="viewCount"):
        battery.bivariate_reports(df)


def test_counts_come_from_the_pass_that_writes_the_copy(spark, files):
    from framescope.operators import profile

    frame = spark.read.csv(str(files / "posts.csv"), header=True)
    watched, observation = profile.counting(frame)
    watched.write.mode("overwrite").parquet(str(files / "copy"))
    before = records_read(spark)
    counted = profile.observed_counts(frame, observation)
    reports = battery.profile_reports(frame, counted)
    got = {name: sorted(map(tuple, reports[name].collect())) for name in ("dataset_shape", "missing_data", "missing_columns", "missing_summary")}
    assert records_read(spark) == before
    assert got == {name: sorted(map(tuple, result.collect())) for name, result in battery.profile_reports(frame).items() if name in got}
