import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from prsignal import schemas
from prsignal.operators.clean import clean_comments
from prsignal.sources import archive, sinks, tables

RAW = {
    "pull_request_url": '"https://api.h/repos/o/r/pulls/7"',
    "pull_patch_url": '"https://h/o/r/pull/7.patch"',
    "created_date": '"2019-04-12T08:09:18Z"',
    "diff_hunks": [r'"@@ -0,0 +1,9 @@\n+a \"x\""', r'"@@ -1,6 +1,17 @@\n+b"', '"@@ -1,1 +1,1 @@"'],
    "comment_positions": [
        {"original_position": "5", "new_position": "5"},
        {"original_position": "13", "new_position": "13"},
        {"original_position": "20"},
    ],
    "comment_text": ["one", "two", "three"],
    "comment_commit_ids": ['"d2b1"', '"d2b1"', '"d2b1"'],
    "comment_file_paths": ['"app/a.rb"', '"app/b.slim"', '"app/c.slim"'],
}


def test_resolve_date():
    as_of = dt.date(2024, 3, 1)
    assert archive.resolve_date("yesterday", as_of) == "20240229"
    assert archive.resolve_date("today", as_of) == "20240301"
    assert archive.resolve_date("2018") == "2018"


def test_scan_days_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = [(i, "IssuesEvent", ("o/r",), "{}", d) for i, d in enumerate(["20171231", "20180101", "20181231"])]
    spark.createDataFrame(rows, schemas.ARCHIVE_EVENT).write.partitionBy("day").parquet(path)
    year = archive.scan_days(archive.read_archive(spark, path), "2018")
    assert {r.day for r in year.collect()} == {"20180101", "20181231"}
    plan = year._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "StartsWith(day" in plan


def test_scan_by_time_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "events")
    times = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-31 23:59:59", "2024-02-01 00:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    df.write.parquet(path)
    events = spark.read.parquet(path)
    month = archive.scan_days_by_time(events, "202401")
    assert month.count() == 2
    assert "GreaterThanOrEqual(ts" in month._jdf.queryExecution().executedPlan().toString()
    assert archive.scan_days_by_time(events, "2024").count() == 3
    assert archive.scan_days_by_time(events, "20240131").count() == 1
    assert archive.scan_days_by_time(events, "2024013").count() == 1  # part of a day


def test_clean_comments(spark):
    df = spark.createDataFrame([(json.dumps([RAW]),)], "value string")
    raw = tables.comments_from_json(df)
    row = clean_comments(raw).first()
    assert row.pull_request_url == "https://api.h/repos/o/r/pulls/7"
    assert [tuple(p) for p in row.comment_positions] == [(5, 5), (13, 13), (20, None)]
    assert row.comment_file_paths == ["app/a.rb", "app/b.slim", "app/c.slim"]
    assert row.comment_commit_ids == ["d2b1"] * 3
    assert row.diff_hunks[0] == '@@ -0,0 +1,9 @@\n+a "x"'
    assert clean_comments(raw).schema.simpleString() == f"struct<{schemas.CLEAN_COMMENTS.replace(', ', ',').replace(' ', ':')}>"


def test_clean_drops_unknown_pull_requests(spark):
    rows = [dict(RAW, pull_request_url=u) for u in (None, "null", '"https://x"')]
    df = spark.createDataFrame([(json.dumps(rows),)], "value string")
    assert [r.pull_request_url for r in clean_comments(tables.comments_from_json(df)).collect()] == ["https://x"]


def test_issue_inputs(spark, tmp_path):
    lines = ["name,url", 'o/r,"""https://h/issues/1"""', 'o/s,"https://h/issues/2"']
    rows = tables.issue_inputs_from_csv(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert [tuple(r) for r in rows.collect()] == [("o/r", '"https://h/issues/1"'), ("o/s", "https://h/issues/2")]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    path = str(tmp_path / "in.csv")
    assert tables.read_issue_inputs(spark, path, "csv").collect() == rows.collect()
    rows.write.parquet(str(tmp_path / "p"))
    assert tables.read_issue_inputs(spark, str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        tables.read_issue_inputs(spark, path, "xml")


def test_read_cache_is_empty_before_the_first_write(spark, tmp_path):
    assert tables.read_cache(spark, str(tmp_path / "none")).count() == 0
    assert tables.read_cache(spark, None).columns == ["pull_request_url", "patch", "diff"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception) as error:
        tables.read_cache(spark, str(tmp_path / "bad")).count()
    assert not isinstance(error.value, AnalysisException)


def test_csv_quotes_and_header_order(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([('he said "x, y"', "a\nb", "3")], "b string, a string, c string").coalesce(1)
    sinks.write_csv(df, path, ("a", "b"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == 'a,b\n"a\nb","he said ""x, y"""\n'


def test_fingerprint_ignores_order_and_layout(spark):
    rows = [(str(i), None if i % 3 else "x") for i in range(50)]
    a = spark.createDataFrame(rows, "k string, v string")
    b = spark.createDataFrame(rows[::-1], "k string, v string").repartition(7)
    assert sinks.fingerprint(a).first() == sinks.fingerprint(b).first()
    changed = spark.createDataFrame([*rows[1:], ("0", "")], "k string, v string")
    assert sinks.fingerprint(a).first() != sinks.fingerprint(changed).first()
    assert tuple(sinks.fingerprint(a.where("false")).first()) == (0, 0)


def test_issue_facts_by_project(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [(f"o/r{i % 3}", f"f{i}.py", i) for i in range(30)]
    sinks.write_issue_facts(spark.createDataFrame(rows, schemas.ISSUE_FACT), path)
    sinks.write_issue_facts(spark.createDataFrame(rows, schemas.ISSUE_FACT), path)  # overwrites
    facts = tables.read_issue_facts(spark, path).where("project = 'o/r1'")
    assert facts.count() == 10
    assert "PartitionFilters: [isnotnull(project" in facts._jdf.queryExecution().executedPlan().toString()


def test_dump(spark, tmp_path):
    df = spark.createDataFrame([(i, f'say "{i}"\n') for i in range(60)], "i int, t string")
    sinks.write_dump(df, str(tmp_path / "json"), str(tmp_path / "escaped"), ["i"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(lines) == 50 and json.loads(min(lines, key=lambda x: json.loads(x)["i"]))["t"] == 'say "0"\n'
    escaped = [r.value for r in spark.read.text(str(tmp_path / "escaped")).collect()]
    assert sorted(json.loads(e) for e in escaped) == sorted(lines)
    assert escaped[0].startswith('"{\\"i\\":')


def test_missing_days_are_written_once(spark, tmp_path):
    path = str(tmp_path / "daily")
    asked = []

    def extract(days):
        asked.append(list(days))
        return spark.createDataFrame([(d, int(d)) for d in days], "day string, n int")

    assert sinks.ingest_missing_days(spark, extract, ["20240101", "20240102"], path) == ["20240101", "20240102"]
    assert sinks.ingest_missing_days(spark, extract, ["20240102", "20240103"], path) == ["20240103"]
    assert sinks.ingest_missing_days(spark, extract, ["20240103"], path) == []
    assert asked == [["20240101", "20240102"], ["20240103"]]
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [20240101, 20240102, 20240103]


def test_merged_schemas(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(str(tmp_path / "t/p=0"))
    spark.createDataFrame([(2, 3.0)], "a int, c double").write.parquet(str(tmp_path / "t/p=1"))
    assert set(tables.read_merged(spark, str(tmp_path / "t")).columns) == {"a", "b", "c", "p"}


def test_a_day_without_rows_is_finished_too(spark, tmp_path):
    path = str(tmp_path / "daily")
    asked = []

    def extract(days):
        asked.append(list(days))
        rows = [(d, 1) for d in days if d != "20240102"]
        return spark.createDataFrame(rows, "day string, n int")

    assert sinks.ingest_missing_days(spark, extract, ["20240102"], path, "a") == ["20240102"]
    assert sinks.ingest_missing_days(spark, extract, ["20240101", "20240102"], path, "b") == ["20240101"]
    assert sinks.ingest_missing_days(spark, extract, ["20240101", "20240102"], path, "c") == []
    assert asked == [["20240102"], ["20240101"]]
    got = sorted(map(tuple, sinks.read_ledger(spark, path).collect()))
    assert got == [("20240101", 1, "b"), ("20240102", 0, "a")]
    assert spark.read.parquet(path).count() == 1


def test_a_run_that_failed_before_its_entry_is_repeated(spark, tmp_path):
    path = str(tmp_path / "daily")
    spark.createDataFrame([("20240101", 7)], "day string, n int").write.partitionBy("day").parquet(path)

    def extract(days):
        return spark.createDataFrame([(d, 8) for d in days], "day string, n int")

    assert sinks.ingest_missing_days(spark, extract, ["20240101"], path) == ["20240101"]
    assert [r.n for r in spark.read.parquet(path).collect()] == [8]
