from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from framescope.functions.guards import require_columns
from framescope.sources import ingest, readers, scratch, sinks

CSV = 'id,text,lang\n1,"two\nlines, and ""quotes""",en\n2,NA,null\n3,"",N/A\n4," ",tl\n'


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_with_line_breaks_and_missing_tokens(spark, csv):
    rows = [tuple(r) for r in readers.as_frame(spark, csv).collect()]
    assert rows == [
        ("1", 'two\nlines, and "quotes"', "en"), ("2", None, None), ("3", None, None), ("4", " ", "tl"),
    ]
    typed = readers.read_csv(spark, csv, "id bigint, text string, lang string")
    assert dict(typed.dtypes)["id"] == "bigint"
    assert dict(readers.read_csv(spark, csv, infer=True).dtypes)["id"] == "int"


def test_source_is_a_frame_or_a_path(spark, tmp_path):
    df = spark.range(3)
    assert readers.as_frame(spark, df) is df
    for name, write in (("a.parquet", df.write.parquet), ("b.json", df.write.json), ("c.orc", df.write.orc)):
        path = str(tmp_path / name)
        write(path)
        assert readers.as_frame(spark, path).count() == 3
    assert readers.format_of("x/y.csv.gz") == "csv" and readers.format_of("/data/folder/") == "parquet"
    with pytest.raises(ValueError, match="suffix"):
        readers.format_of("table.xlsx")


def test_ingest_keeps_an_existing_target(spark, csv, tmp_path, caplog):
    target = str(tmp_path / "posts.parquet")
    assert ingest.ingest(spark, csv, target).count() == 4
    stamp = sorted(os.listdir(target))
    with open(csv, "a") as more:
        more.write("5,new,en\n")
    assert ingest.ingest(spark, csv, target).count() == 4
    assert sorted(os.listdir(target)) == stamp
    assert ingest.ingest(spark, str(tmp_path / "absent.csv"), target) is None
    assert "nothing to ingest" in caplog.text


def test_broken_targets_are_written_again(spark, csv, tmp_path):
    half = tmp_path / "half.parquet"
    spark.range(3).write.parquet(str(half))
    os.remove(half / "_SUCCESS")
    assert ingest.ingest(spark, csv, str(half)).count() == 4
    empty = tmp_path / "empty.parquet"
    empty.mkdir()
    assert ingest.ingest(spark, csv, str(empty), infer=True).schema["id"].dataType.simpleString() == "int"


def test_reports_are_replaced(spark, tmp_path):
    out = str(tmp_path / "new" / "folder")
    assert sinks.base_name("data/posts.csv.gz") == "posts"
    for rows, fmt in ((3, "parquet"), (2, "parquet"), (4, "json")):
        path = sinks.write_report(spark.range(rows), out, "posts", f"shape_{fmt}", fmt)
        assert path == f"{out}/posts_shape_{fmt}"
        assert spark.read.format(fmt).load(path).count() == rows
    with pytest.raises(ValueError, match="format"):
        sinks.write_report(spark.range(1), out, "posts", "shape", "png")


def test_scratch_follows_the_setting_of_the_session(spark):
    # The setting is fixed when a session starts, so a stand-in shows the other case.
    cluster = SimpleNamespace(conf=SimpleNamespace(get={"spark.checkpoint.dir": "/shared/"}.get))
    assert scratch.new_path(cluster, "x").startswith("/shared/x-")
    first, second = scratch.new_path(spark, "x"), scratch.new_path(spark, "x")
    assert first != second and os.path.dirname(first) == os.path.dirname(second)


def test_guard_names_every_absent_column(spark):
    df = spark.createDataFrame([], "a int")
    assert require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        require_columns(df, ["b", "a", "c"])


def test_spread_only_when_asked(spark):
    narrow = spark.range(8).coalesce(1)
    assert readers.spread(narrow).rdd.getNumPartitions() == 1
    spark.conf.set("framescope.spread.partitions", "3")
    try:
        assert readers.spread(narrow).rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("framescope.spread.partitions")


RAGGED = "id,text,lang\n1,a,en\n2,b\n3,c,fr,extra\nx,d,de\n5,NA,es\n"


def test_malformed_rows_are_put_aside_and_reported(spark, tmp_path):
    from framescope.operators import quality

    path = tmp_path / "ragged.csv"
    path.write_text(RAGGED)
    schema = "id int, text string, lang string"
    frame = readers.read_csv(spark, str(path), schema, corrupt=readers.CORRUPT)
    assert frame.columns == ["id", "text", "lang", readers.CORRUPT]
    aside = str(tmp_path / "aside")
    rows = ingest.ingest(spark, str(path), str(tmp_path / "rows"), schema, quarantine=aside)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a", "en"), (5, None, "es")]
    malformed = spark.read.parquet(aside)
    assert sorted(r["record"] for r in malformed.collect()) == ["2,b", "3,c,fr,extra", "x,d,de"]
    report = [tuple(r)[:5] for r in quality.exception_report(rows, quality.Expectations(), malformed).collect()]
    assert report == [("Malformed Rows", "", "rows that could not be read", 3, 60.0)]
    assert quality.exception_report(rows, quality.Expectations(), malformed.where("false")).collect() == []
    with pytest.raises(ValueError, match="schema"):
        readers.read_csv(spark, str(path), corrupt=readers.CORRUPT)


def test_a_changed_source_is_ingested_again_on_request(spark, csv, tmp_path, monkeypatch):
    target = str(tmp_path / "posts.parquet")
    assert ingest.ingest(spark, csv, target, refresh=True).count() == 4
    stamp = sorted(os.listdir(target))
    assert ingest.ingest(spark, csv, target, refresh=True).count() == 4
    assert sorted(os.listdir(target)) == stamp
    with open(csv, "a") as more:
        more.write("5,new,en\n")
    seen = []
    swap = ingest.swap
    # A reader between the write and the swap sees the whole old table.
    monkeypatch.setattr(ingest, "swap", lambda s, staged, place: seen.append(s.read.parquet(place).count()) or swap(s, staged, place))
    assert ingest.ingest(spark, csv, target, refresh=True).count() == 5
    assert seen == [4] and sorted(p for p in os.listdir(tmp_path) if "parquet" in p) == ["posts.parquet"]


def test_names_with_dots(spark, tmp_path):
    from framescope.operators import profile

    path = tmp_path / "dotted.csv"
    path.write_text("a.b,c`d\nNA,1\n2,\n")
    df = readers.read_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [(None, "1"), ("2", None)]
    assert {(r["column"], r["n_missing"]) for r in profile.missing_report(df).collect()} == {("a.b", 1), ("c`d", 1)}
