"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.functions import text as X
from prsignal.functions.messages import suggestion_message
from prsignal.operators import clean, comments, extract, features, issues, label, metrics, patch, resolve
from prsignal.operators import model as ml
from prsignal.operators import sample, score
from prsignal.plans import fixtures as V
from prsignal.plans import jobs
from prsignal.session import checkpoint_dir, materialize, materialize_last
from prsignal.sources import archive, sinks, tables
from prsignal.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Stand-in for a line break where lists of texts are shown as one text.
SEP = "¶"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def shown(array: str | Column) -> Column:
    return F.array_join(array, SEP, "∅")


def _fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the session."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- patches ---------------------------------------------------------------


@query
def changed_lines_by_extension(spark, sf_dir):
    """Flagship: changed lines per extension and direction."""
    lines = patch.parse_patches(V.patches(spark, sf_dir))
    return lines.groupBy(
        F.coalesce(X.extension(F.col("filename")), F.lit("other")).alias("extension"), "is_added"
    ).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.countDistinct("filename").alias("n_files"),
        F.sum(F.col("new_pos").cast("bigint")).alias("sum_new_pos"),
        F.sum(F.col("position").cast("bigint")).alias("sum_position"),
        F.sum(F.length("text").cast("bigint")).alias("n_chars"),
    )


@query
def changed_lines(spark, sf_dir):
    """Every changed line with positions and both contexts."""
    return patch.parse_patches(V.patches(spark, sf_dir)).select(
        "patch_id", "line_at", "commit_id", "old_pos", "new_pos", "position",
        shown("previous_lines").alias("previous_lines"), "text",
        shown("next_lines").alias("next_lines"), "filename", "is_added",
    )


@query
def changed_lines_up_to_2000(spark, sf_dir):
    """The described filter: lines of 2,000 characters and more left out."""
    lines = patch.parse_patches(V.patches(spark, sf_dir), max_length=patch.DESCRIBED_MAX_LENGTH)
    return lines.select("patch_id", "line_at", F.length("text").alias("n_chars"))


@query
def changed_long_lines(spark, sf_dir):
    """Patches that change one line as long as a document; none is left out."""
    return patch.parse_patches(V.long_patches(spark, sf_dir)).select(
        "patch_id", "line_at", "position", "text", "is_added"
    )


@query
def changed_lines_short_context(spark, sf_dir):
    """The parser with two lines of context either way."""
    lines = patch.parse_patches(V.patches(spark, sf_dir), previous_lines=2, next_lines=2)
    return lines.select(
        "patch_id", "line_at", shown("previous_lines").alias("previous_lines"),
        shown("next_lines").alias("next_lines"),
    )


@query
def hunk_lines(spark, sf_dir):
    """Changed lines of review-comment hunks (hunk mode)."""
    hunks = label.comment_hunks(V.resolved(spark, sf_dir))
    return patch.parse_patches(hunks, ["pull_request_url", "item"], "hunk", hunk_mode=True).select(
        "pull_request_url", "item", "line_at", "old_pos", "new_pos", "position",
        shown("previous_lines").alias("previous_lines"), "text",
        shown("next_lines").alias("next_lines"), "is_added",
    )


@query
def patch_rejects(spark, sf_dir):
    """Patches that cannot be parsed, with the reason."""
    return patch.rejected_patches(V.patches(spark, sf_dir)).select("error", "patch")


@query
def patch_rejects_written(spark, sf_dir):
    """The same, through the JSON sink."""
    path = _fresh_path(spark, "rejects")
    sinks.write_rejects(patch.rejected_patches(V.patches(spark, sf_dir)), path)
    return spark.read.schema("patch string, error string").json(path).select("error", "patch")


# -- archive and extract ---------------------------------------------------


@query
def archive_day_scan(spark, sf_dir):
    """Shards by date prefix."""
    days = archive.scan_days(V.archive_events(spark, sf_dir), "2024011")
    return days.groupBy("day", "type").agg(F.count(F.lit(1)).alias("n"))


@query
def archive_month_scan(spark, sf_dir):
    """Shards by date prefix on a table with a timestamp: a pushed time range."""
    events = archive.scan_days_by_time(V.table(spark, sf_dir, "events"), "202401")
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event")
    )


@query
def archive_yesterday(spark, sf_dir):
    """The shard of the day before a given date."""
    day = archive.resolve_date("yesterday", as_of=dt.date(2024, 1, 15))
    days = archive.scan_days(V.archive_events(spark, sf_dir), day)
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query
def archive_partitions(spark, sf_dir):
    """The archive written by day and scanned with partition pruning."""
    path = _fresh_path(spark, "archive")
    V.archive_events(spark, sf_dir).drop("ts").write.partitionBy("day").parquet(path)
    days = archive.scan_days(archive.read_archive(spark, path), "2024010")
    return days.groupBy("day", F.col("repo.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query
def review_events(spark, sf_dir):
    return extract.review_events(V.archive_events(spark, sf_dir)).select("event_id", "type", "day")


@query
def undecodable_events(spark, sf_dir):
    """Rows whose payload is not JSON."""
    _, bad = extract.split_undecodable(V.archive_events(spark, sf_dir))
    return bad.select("event_id", "type", "payload")


@query
def review_comments(spark, sf_dir):
    """JSON fields of review events with default positions."""
    return extract.review_comments(V.archive_events(spark, sf_dir)).drop("created_at")


def _shown_comments(grouped: DataFrame) -> DataFrame:
    arrays = (
        "comments_positions", "comments_original_positions", "comment_commit_ids",
        "comment_file_paths", "comment_text", "diff_hunks",
    )
    return grouped.select(
        "pull_request_url", "part", "pull_patch_url", *(shown(a).alias(a) for a in arrays)
    )


@query
def comments_by_pull_request(spark, sf_dir):
    """Comments of a pull request as aligned arrays."""
    comments = extract.review_comments(V.archive_events(spark, sf_dir))
    return _shown_comments(extract.comments_by_pull_request(comments))


@query
def comments_in_parts(spark, sf_dir):
    """The same where a pull request with over 20 comments takes several rows."""
    comments = extract.review_comments(V.archive_events(spark, sf_dir))
    return _shown_comments(extract.comments_by_pull_request(comments, max_comments=20))


def _cells(spark, sf_dir):
    comments = extract.review_comments(V.archive_events(spark, sf_dir))
    return extract.comment_cells(extract.comments_by_pull_request(comments))


@query
def comment_cells(spark, sf_dir):
    """The CSV form of the extract."""
    return _cells(spark, sf_dir)


@query
def comment_cells_first_100(spark, sf_dir):
    """The cell limit of the extract."""
    return extract.limit_cells(_cells(spark, sf_dir), 100, ["pull_request_url"])


@query
def comment_cells_fingerprint(spark, sf_dir):
    """Content id of the extract."""
    return sinks.fingerprint(_cells(spark, sf_dir), sinks.COMMENT_CSV_HEADER)


@query
def comment_cells_through_csv(spark, sf_dir):
    """The extract written as CSV and read back."""
    path = _fresh_path(spark, "cells")
    sinks.write_csv(_cells(spark, sf_dir), path, sinks.COMMENT_CSV_HEADER)
    schema = ", ".join(f"{c} string" for c in sinks.COMMENT_CSV_HEADER)
    back = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')
    return back.select(*(F.coalesce(c, F.lit("")).alias(c) for c in sinks.COMMENT_CSV_HEADER))


@query
def opened_issues(spark, sf_dir):
    return extract.opened_issues(V.archive_events(spark, sf_dir))


@query
def issue_inputs_through_csv(spark, sf_dir):
    """Opened issues written as CSV and read with a fixed schema."""
    path = _fresh_path(spark, "issues")
    sinks.write_csv(extract.opened_issues(V.archive_events(spark, sf_dir)), path, sinks.ISSUE_CSV_HEADER)
    return tables.read_issue_inputs(spark, path, "csv")


@query
def issue_inputs_through_parquet(spark, sf_dir):
    """Opened issues written as Parquet and read with a fixed schema, dealt over a given number of tasks."""
    path = _fresh_path(spark, "issues")
    extract.opened_issues(V.archive_events(spark, sf_dir)).write.parquet(path)
    return tables.read_issue_inputs(spark, path, "parquet", partitions=7)


@query
def missing_days(spark, sf_dir):
    """Days of the archive that an output does not hold yet."""
    events = V.archive_events(spark, sf_dir)
    present = events.where(F.col("type") == "IssuesEvent").where(F.col("event_id") % 2 == 1)
    present = present.where(~F.substring("day", 7, 2).isin("03", "14", "27"))
    return archive.missing_days(events, present)


@query
def ingested_days(spark, sf_dir):
    """Daily extract run twice over overlapping days: every day is there once."""
    path = _fresh_path(spark, "daily")
    events = V.archive_events(spark, sf_dir)

    def extract_days(days: list[str]) -> DataFrame:
        comments = extract.review_comments(events.where(F.col("day").isin(days)), keep=["day"])
        return extract.comments_by_pull_request(comments, keys=["day", "pull_request_url"])

    sinks.ingest_missing_days(spark, extract_days, ["20240102", "20240103"], path)
    sinks.ingest_missing_days(spark, extract_days, ["20240103", "20240104"], path)
    back = spark.read.schema("day string, comments_positions array<string>").parquet(path)
    return back.groupBy("day").agg(
        F.count(F.lit(1)).alias("n_pull_requests"),
        F.sum(F.size("comments_positions").cast("bigint")).alias("n_comments"),
    )


@query
def ingested_days_with_empty_day(spark, sf_dir):
    """Three runs over requested days, one of which has no comments: the third run extracts nothing."""
    path = _fresh_path(spark, "ledger")
    events, asked = V.archive_events(spark, sf_dir), []

    def extract_days(days: list[str]) -> DataFrame:
        asked.append(days)
        found = extract.review_comments(events.where(F.col("day").isin(days)), keep=["day"])
        return found.select("day", "event_id", "pull_request_url")

    for days in (["20240102", "20240103", "20231231"], ["20240103", "20240104", "20231231"], ["20231231", "20240104"]):
        requested = spark.createDataFrame([(d,) for d in days], "value string")
        requested.coalesce(1).write.mode("append").text(f"{path}/requested")
        texts = stream.read_event_texts(spark, f"{path}/requested")
        stream.start_daily_ingest(texts, extract_days, f"{path}/days", f"{path}/state").awaitTermination()
    times = spark.createDataFrame([(d,) for days in asked for d in days], "day string")
    times = times.groupBy("day").agg(F.count(F.lit(1)).alias("n_extracts"))
    return sinks.read_ledger(spark, f"{path}/days").join(times, "day")


# -- cleaning --------------------------------------------------------------


@query
def known_pull_requests(spark, sf_dir):
    raw = clean.known_pull_requests(V.raw_comments(spark, sf_dir))
    return raw.select("pull_request_url", "pull_patch_url")


def _shown_clean(df: DataFrame) -> DataFrame:
    positions = F.col("comment_positions")
    return df.select(
        "pull_request_url",
        "pull_patch_url",
        shown(F.transform(positions, lambda p: p["original_position"].cast("string"))).alias("old"),
        shown(F.transform(positions, lambda p: p["new_position"].cast("string"))).alias("new"),
        shown("comment_text").alias("comment_text"),
        shown("diff_hunks").alias("diff_hunks"),
        shown("comment_file_paths").alias("comment_file_paths"),
        shown("comment_commit_ids").alias("comment_commit_ids"),
    )


@query
def clean_comments(spark, sf_dir):
    """Quotes stripped, hunks decoded, positions as ints."""
    return _shown_clean(clean.clean_comments(V.raw_comments(spark, sf_dir)))


@query
def archive_to_clean_comments(spark, sf_dir):
    """Comments of the archive in the nested form of the ingest, cleaned."""
    found = extract.review_comments(V.archive_events(spark, sf_dir))
    raw = extract.to_raw_comments(extract.comments_by_pull_request(found))
    return _shown_clean(clean.clean_comments(raw))


@query
def comments_through_json(spark, sf_dir):
    """Raw comments as JSON texts, read with the fixed schema and cleaned."""
    texts = V.raw_comments(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    return _shown_clean(clean.clean_comments(tables.comments_from_json(texts)))


@query
def comments_through_parquet(spark, sf_dir):
    """Raw comments written as Parquet and read with the fixed schema."""
    path = _fresh_path(spark, "comments")
    V.raw_comments(spark, sf_dir).write.parquet(path)
    return _shown_clean(clean.clean_comments(tables.read_comments(spark, path)))


# -- resolving -------------------------------------------------------------


def _inputs(spark, sf_dir):
    return clean.clean_comments(V.raw_comments(spark, sf_dir))


@query
def uncached_pull_requests(spark, sf_dir):
    todo = resolve.not_cached(_inputs(spark, sf_dir), V.cached_patches(spark, sf_dir))
    return todo.select("pull_request_url", "pull_patch_url")


@query
def wanted_urls(spark, sf_dir):
    """Patch and diff urls still to fetch."""
    todo = resolve.not_cached(_inputs(spark, sf_dir), V.cached_patches(spark, sf_dir))
    return resolve.wanted_urls(todo)


@query
def fetched_responses(spark, sf_dir):
    """The response table filled by a fetch function that some urls make fail."""

    def fetch(url: str) -> tuple[int, str]:
        if url.endswith("7.diff"):
            raise OSError("no answer")
        return (404 if url.endswith("3.patch") else 200), f"body of {url}"

    urls = resolve.wanted_urls(_inputs(spark, sf_dir))
    return resolve.fetch_responses(urls, fetch)


@query
def fetched_again(spark, sf_dir):
    """Requests that failed made once more; all have an answer then, each once."""

    def fetch(url: str) -> tuple[int, str]:
        if url.endswith("7.diff"):
            raise OSError("no answer")
        return 200, "first"

    urls = resolve.wanted_urls(_inputs(spark, sf_dir))
    first = materialize(resolve.fetch_responses(urls, fetch))
    second = resolve.fetch_responses(resolve.wanted_again(urls, first), lambda url: (200, "second"))
    return first.where("status IS NOT NULL").unionByName(second).drop("error")


def _resolved(spark, sf_dir):
    return resolve.resolve_patches(
        _inputs(spark, sf_dir), V.cached_patches(spark, sf_dir), V.responses(spark, sf_dir)
    )


@query
def resolve_patches(spark, sf_dir):
    """Inputs that are not cached, joined to patch and diff texts that were found."""
    return _resolved(spark, sf_dir).select(
        "pull_request_url", "pull_patch_url",
        F.size("parsed_input.comment_text").alias("n_comments"), F.md5("patch").alias("patch_md5"),
        "diff",
    )


@query
def resolve_with_cache(spark, sf_dir):
    """Ingest run twice with a cache: the second run appends nothing."""
    out, cache = _fresh_path(spark, "resolved"), _fresh_path(spark, "cache")
    raw = materialize(V.raw_comments(spark, sf_dir))
    for _ in range(2):
        resolve.fetch_and_store(
            clean.clean_comments(raw), tables.read_cache(spark, cache), V.responses(spark, sf_dir), out, cache
        )
    results = tables.read_resolved(spark, out).select("pull_request_url", F.lit("result").alias("kept_as"))
    stored = tables.read_cache(spark, cache).select("pull_request_url", F.lit("cache").alias("kept_as"))
    return results.unionByName(stored)


@query
def resolve_with_cache_compat(spark, sf_dir):
    """The older ingest: a second run finds everything in the cache and appends nothing."""
    out, cache = _fresh_path(spark, "resolved"), _fresh_path(spark, "cache")
    for _ in range(2):
        resolve.fetch_and_store(
            _inputs(spark, sf_dir), tables.read_cache(spark, cache), V.responses(spark, sf_dir), out, cache, compat=True
        )
    return tables.read_resolved(spark, out).select("pull_request_url")


@query
def late_comments_on_cached(spark, sf_dir):
    """Three ingest runs: the first day, the second day with the first once more, and both again.

    Comments of the second day are on pull requests that are in the cache by then.
    """
    out, cache = _fresh_path(spark, "resolved"), _fresh_path(spark, "cache")
    rows = V.resolved_by_day(spark, sf_dir)
    cleaned = materialize(rows.select("day", "parsed_input.*"))
    for days in (["20240101"], ["20240101", "20240102"], ["20240101", "20240102"]):
        resolve.fetch_and_store(
            cleaned.where(F.col("day").isin(days)).drop("day"),
            tables.read_cache(spark, cache), V.responses(spark, sf_dir), out, cache,
        )
    stored = tables.read_cache(spark, cache).groupBy("pull_request_url").agg(F.count(F.lit(1)).alias("n_cached"))
    return (
        tables.read_resolved(spark, out)
        .groupBy("pull_request_url")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.size("parsed_input.comment_text").cast("bigint")).alias("n_comments"),
            F.countDistinct(F.sha2("patch", 256)).alias("n_patches"),
        )
        .join(stored, "pull_request_url", "left")
    )


@query
def resolve_issues(spark, sf_dir):
    pages = resolve.resolve_issues(V.issue_inputs(spark, sf_dir), V.issue_responses(spark, sf_dir))
    return pages.select("name", F.md5("body").alias("body_md5"))


# -- issues ----------------------------------------------------------------


@query
def issue_facts(spark, sf_dir):
    """Stack-trace facts, each once."""
    return issues.issue_facts(V.issue_bodies(spark, sf_dir))


@query
def issue_facts_with_repeats(spark, sf_dir):
    """Stack-trace facts with repeats, counted."""
    facts = issues.issue_facts(V.issue_bodies(spark, sf_dir), dedupe=False)
    return facts.groupBy("project", "filename", "line").agg(F.count(F.lit(1)).alias("n"))


@query
def issue_facts_by_project(spark, sf_dir):
    """Facts written in folders by project, read with a pruning filter."""
    path = _fresh_path(spark, "facts")
    sinks.write_issue_facts(issues.issue_facts(V.issue_bodies(spark, sf_dir)), path)
    facts = tables.read_issue_facts(spark, path)
    return facts.where(F.col("project").startswith("org3/")).select("project", "filename", "line")


# -- labels ----------------------------------------------------------------


def _shown_records(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "pull_request_url", shown("previous_lines").alias("previous_lines"), "line_text",
        shown("next_lines").alias("next_lines"), "filename", "is_added", "commented", "line",
        "comment_text", *more,
    )


@query
def comment_hunks(spark, sf_dir):
    """Parallel arrays zipped by index."""
    return label.comment_hunks(V.resolved(spark, sf_dir))


@query
def hunk_records(spark, sf_dir):
    records = label.hunk_records(V.resolved(spark, sf_dir))
    return _shown_records(records.withColumn("item", F.col("item").cast("int")), "item", "line_at")


@query
def hunk_records_last_line(spark, sf_dir):
    records = label.hunk_records(V.resolved(spark, sf_dir), last_line_only=True)
    return records.select("pull_request_url", F.col("item").cast("int").alias("item"), "line_at", "line_text")


def _flagged(spark, sf_dir, **options):
    lines = V.changed(spark, sf_dir)
    marks = label.comment_marks(V.resolved(spark, sf_dir))
    return label.flag_commented_lines(lines, marks, **options)


@query
def commented_lines(spark, sf_dir):
    """Lines that a comment on their commit points at."""
    return _flagged(spark, sf_dir, flags=["hit"]).where("hit").select(
        "pull_request_url", "line_at", "commit_id", "filename", "position"
    )


@query
def lines_near_comments(spark, sf_dir):
    """Lines within one position of a comment on any commit."""
    return _flagged(spark, sf_dir, flags=["near"]).where("near").select(
        "pull_request_url", "line_at", "filename", "position"
    )


@query
def commented_lines_compat(spark, sf_dir):
    """Both flags with positions read as file line numbers."""
    return _flagged(spark, sf_dir, compat=True).where("hit or near").select(
        "pull_request_url", "line_at", "old_pos", "new_pos", "hit", "near"
    )


@query
def patch_records(spark, sf_dir):
    return _shown_records(label.patch_records(V.resolved(spark, sf_dir)), "line_at")


@query
def patch_records_compat(spark, sf_dir):
    return _shown_records(label.patch_records(_stored(spark, sf_dir), compat=True), "line_at")


def _records(spark, sf_dir):
    df = V.resolved(spark, sf_dir)
    return label.all_records(df)


@query
def distinct_records(spark, sf_dir):
    """Hunk and patch records together, structurally distinct."""
    return _shown_records(label.distinct_records(_stored(spark, sf_dir)))


@query
def records_with_comments(spark, sf_dir):
    """Records of pull requests that have a commented one."""
    return label.with_commented_lines(_records(spark, sf_dir)).select(
        "pull_request_url", "source", F.col("item").cast("int").alias("item"), "line_at", "commented"
    )


@query
def first_per_text(spark, sf_dir):
    """One record per line text, by priority."""
    return label.first_per_text(_records(spark, sf_dir)).select(
        "pull_request_url", "source", F.col("item").cast("int").alias("item"), "line_at", "line_text",
        "commented",
    )


def _stored(spark, sf_dir) -> DataFrame:
    """Pull requests as the jobs read them: from a table, of which each step reads its columns."""
    return materialize(V.resolved(spark, sf_dir))


@query
def labelled_lines(spark, sf_dir):
    return _shown_records(label.labelled_lines(_stored(spark, sf_dir)))


@query
def labelled_lines_compat(spark, sf_dir):
    return _shown_records(label.labelled_lines(_stored(spark, sf_dir), compat=True))


def _clustered(spark, *parts: DataFrame) -> DataFrame:
    """Comments added one after the other to a table that is clustered by pull request and file."""
    path = _fresh_path(spark, "comments")
    name = "comments_" + path.rsplit("-", 1)[1]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    comments.attach_comments(spark, name, path, buckets)
    for part in parts:
        comments.add_comments(part, name)
    return spark.table(name)


@query
def labelled_lines_by_day(spark, sf_dir):
    """Labels where the comments of a pull request came on two days, the second with a newer patch."""
    rows = materialize(V.resolved_by_day(spark, sf_dir))
    days = [
        comments.comments_of_rows(rows.where(F.col("day") == day), "day") for day in ("20240101", "20240102")
    ]
    return _shown_records(label.labelled(label.newest_patches(rows, "day"), _clustered(spark, *days)))


@query
def labelled_lines_hot(spark, sf_dir):
    """Labels where a third of all comments belong to one pull request."""
    patches = V.resolved(spark, sf_dir).select("pull_request_url", "patch")
    return _shown_records(label.labelled(patches, _clustered(spark, V.hot_comments(spark, sf_dir))))


# -- features --------------------------------------------------------------


@query
def file_extensions(spark, sf_dir):
    """Base name and listed extension of file names and page urls."""
    names = V.changed(spark, sf_dir).select("filename").unionByName(
        V.table(spark, sf_dir, "pages").select(F.col("url").alias("filename"))
    )
    return names.distinct().select(
        "filename",
        X.basename(F.col("filename")).alias("basename"),
        X.extension(F.col("filename")).alias("extension"),
    )


@query
def line_features(spark, sf_dir):
    """Features of the lines of all documents."""
    lines = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text")
    )
    f = features.line_features(F.col("text"), F.expr(V.FILE_ONE))
    compat = features.line_features(F.col("text"), F.expr(V.FILE_ONE), compat=True)
    return lines.select(
        "doc_id", "at", *(c.alias(n) for n, c in f.items()),
        compat["only_spaces"].alias("only_spaces_compat"),
    )


def _facts(spark, sf_dir, dedupe=True):
    return issues.issue_facts(V.issue_bodies(spark, sf_dir), dedupe)


def _shown_prepared(df: DataFrame, *more: str) -> DataFrame:
    keep = [c for c in features.PREPARED_COLUMNS if c not in ("previous_lines", "next_lines")]
    return df.select(
        *more, *keep, shown("previous_lines").alias("previous_lines"),
        shown("next_lines").alias("next_lines"),
    )


@query
def prepared_training(spark, sf_dir):
    """Labelled lines with all features, Python files only."""
    labelled = label.labelled_lines(_stored(spark, sf_dir))
    return _shown_prepared(features.prepare_training_data(labelled, _facts(spark, sf_dir)))


@query
def prepared_training_all_files(spark, sf_dir):
    labelled = label.labelled_lines(_stored(spark, sf_dir))
    prepared = features.prepare_training_data(
        labelled, _facts(spark, sf_dir), py_only=False, keep=("pull_request_url",)
    )
    return _shown_prepared(prepared, "pull_request_url")


@query
def prepared_training_compat(spark, sf_dir):
    """The older join: any project, one row per matching fact; counted per line."""
    labelled = label.labelled_lines(_stored(spark, sf_dir), compat=True)
    prepared = features.prepare_training_data(
        labelled,
        _facts(spark, sf_dir, dedupe=False),
        compat=True,
        keep=("pull_request_url", "line"),
    )
    return prepared.select(
        "pull_request_url", "line_text", "line", "label", "only_spaces", "not_in_issues", F.col("copies").alias("n")
    )


@query
def prepared_scoring(spark, sf_dir):
    """Changed lines of new pull requests with the features of scoring."""
    prepared = features.prepare_scoring_data(
        V.changed(spark, sf_dir), _facts(spark, sf_dir), keep=("pull_request_url", "line_at")
    )
    return _shown_prepared(prepared, "pull_request_url", "line_at")


@query
def prepared_scoring_of_projects(spark, sf_dir):
    """The same for the pull requests of one organisation: only its folders of facts are read."""
    path = _fresh_path(spark, "facts")
    sinks.write_issue_facts(_facts(spark, sf_dir), path)
    lines = V.changed(spark, sf_dir).where(F.col("project").startswith("org3/"))
    projects = V.documents(spark, sf_dir).selectExpr(f"{V.project('doc_id')} AS project")
    prepared = features.prepare_scoring_data(
        lines,
        tables.read_issue_facts(spark, path),
        keep=("pull_request_url", "line_at"),
        projects=projects.where(F.col("project").startswith("org3/")),
    )
    return _shown_prepared(prepared, "pull_request_url", "line_at")


# -- sampling --------------------------------------------------------------


def _prepared_of(rows: DataFrame, facts: DataFrame) -> DataFrame:
    labelled = label.labelled_lines(rows)
    return features.prepare_training_data(labelled, facts, py_only=False, keep=("pull_request_url",))


def _prepared(spark, sf_dir):
    return _prepared_of(_stored(spark, sf_dir), _facts(spark, sf_dir))


@query
def train_test_split(spark, sf_dir):
    """Split by pull request, 90 to 10."""
    train, test = sample.split_by_key(V.resolved(spark, sf_dir).select("pull_request_url"))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query
def dataset_summary(spark, sf_dir):
    return sample.summarize(_prepared(spark, sf_dir))


def _to_balance(spark, sf_dir):
    """Prepared rows without their context, which balancing and training don't look at, from a table."""
    return materialize_last(spark, lambda: _prepared(spark, sf_dir).drop(*ml.CONTEXT))


@query
def balanced_classes(spark, sf_dir):
    """Positives repeated ceil(total / positives) times."""
    return sample.balance_classes(_to_balance(spark, sf_dir)).groupBy(
        "pull_request_url", "line_text", "label"
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def balanced_classes_by_negatives(spark, sf_dir):
    return sample.balance_classes(_to_balance(spark, sf_dir), "negatives").groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )


# -- model -----------------------------------------------------------------


@query
def extension_index(spark, sf_dir):
    """Index of extensions as the fitted indexer assigns it to lines."""
    lines = V.changed(spark, sf_dir).select(X.extension(F.col("filename")).alias("extension"))
    lines = materialize(lines)
    return ml.indexer().fit(lines).transform(lines).distinct()


@query
def tokens(spark, sf_dir):
    """Words of every line as the tokenizer of the model gives them, counted."""
    lines = V.changed(spark, sf_dir).select(F.col("text").alias("line_text"))
    words = ml.tokenizer().transform(lines).select(F.explode("tokens").alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def hashed_words(spark, sf_dir):
    """Document frequencies of hashed words: lines, lines with a word, and whether fitted and counted ones agree.

    Columns of rare words, which get no weight, are left out.
    """
    lines = materialize(V.changed(spark, sf_dir).select(F.col("text").alias("line_text")))
    hashed, weights = ml.term_frequencies(n_hashes=1 << 10)
    rows = hashed.transform(ml.tokenizer().transform(lines))
    fitted = weights.fit(rows)
    counted = (
        rows.select(F.posexplode(vector_to_array("raw_tf")).alias("column", "tf"))
        .where("tf > 0")
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= ml.MIN_DOC_FREQ)
    )
    frequencies = [(i, int(n)) for i, n in enumerate(fitted.docFreq) if n >= ml.MIN_DOC_FREQ]
    known = spark.createDataFrame(frequencies, "column int, fitted bigint")
    agree = known.join(counted, "column", "full").agg(F.bool_and(F.expr("fitted <=> n")).alias("agree")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size("tokens") > 0).alias("n_with_words"), agree.alias("agree")
    )


@query
def weighted_classes(spark, sf_dir):
    """Weights of rows in training, instead of copies."""
    return sample.weigh_classes(_to_balance(spark, sf_dir)).groupBy("label", "weight").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def training_folds(spark, sf_dir):
    """Folds of cross validation: every pull request is in one of them."""
    folds = ml.with_folds(_prepared(spark, sf_dir))
    return folds.groupBy("pull_request_url", "fold").agg(F.count(F.lit(1)).alias("n"))


@query
def prep_models(spark, sf_dir):
    """Preparation steps fitted, kept and found again: by the same rows and options only."""
    store = _fresh_path(spark, "prep")
    rows = _to_balance(spark, sf_dir)
    others = rows.where("is_added")
    steps = (("first", rows, 64), ("again", rows, 64), ("other options", rows, 32), ("other rows", others, 64))
    out = []
    for name, df, n_hashes in steps:
        there = ml.path_exists(spark, ml.prep_address(df, store, n_hashes=n_hashes))
        kept = ml.load_or_fit_prep(df, store, n_hashes=n_hashes)
        fitted = ml.fit_prep(df, n_hashes=n_hashes)
        # Both ways once: each row's features occur as often in one as in the other.
        ways = [
            m.transform(df).select(
                F.md5(F.to_json(vector_to_array("features"))).alias("row"), F.lit(i).alias("of_kept")
            )
            for m, i in ((kept, 1), (fitted, 0))
        ]
        counts = ways[0].unionByName(ways[1]).groupBy("row").agg(
            F.sum("of_kept").alias("n"), F.sum(1 - F.col("of_kept")).alias("m")
        )
        out.append(
            counts.agg(
                F.sum(F.when(F.col("n") > 0, F.col("n"))).alias("n_rows"),
                F.coalesce(F.bool_and(F.col("n") == F.col("m")), F.lit(True)).alias("agree"),
            ).select(F.lit(name).alias("step"), F.lit(there).alias("found"), "n_rows", "agree")
        )
    return functools.reduce(DataFrame.unionByName, out)


@query
def word_vectors(spark, sf_dir):
    """Features with word vectors, and with term frequencies: rows by the size of the vector."""
    rows = _to_balance(spark, sf_dir)
    sizes = {"vectors": {"word_vectors": True, "vector_size": 6, "min_count": 1}, "frequencies": {"n_hashes": 32}}
    out = [
        ml.fit_prep(rows, **options).transform(rows)
        .groupBy(F.lit(name).alias("kind"), F.size(vector_to_array("features")).alias("size"))
        .agg(F.count(F.lit(1)).alias("n"))
        for name, options in sizes.items()
    ]
    return functools.reduce(DataFrame.unionByName, out)


# Small settings for queries that train.
_TOY = {"prep_options": {"n_hashes": 64}, "classifier_options": {"maxIter": 3, "maxDepth": 3}}


@query
def model_report(spark, sf_dir):
    """Train on most pull requests with the whole grid, evaluate on the rest."""
    _, report = ml.train_and_evaluate(_stored(spark, sf_dir), _facts(spark, sf_dir), **_TOY)
    return report.select("n", "positives", F.col("pr").between(0, 1).alias("has_pr"),
                         F.col("roc").between(0, 1).alias("has_roc"), F.size("cv").alias("n_models"))


@query
def training_job(spark, sf_dir):
    """The training job from paths to paths: its report and rejects as written, and that its model scores."""
    path = _fresh_path(spark, "training")
    V.resolved(spark, sf_dir).write.parquet(f"{path}/resolved")
    sinks.write_issue_facts(_facts(spark, sf_dir), f"{path}/facts")
    jobs.train(spark, f"{path}/resolved", f"{path}/facts", f"{path}/out", f"{path}/prep", fast=True, **_TOY)
    report = spark.read.json(f"{path}/out/effectiveness")
    rejects = spark.read.schema("patch string, error string").json(f"{path}/out/rejects")
    model = PipelineModel.load(f"{path}/out/model")
    rows, facts = tables.read_resolved(spark, f"{path}/resolved"), tables.read_issue_facts(spark, f"{path}/facts")
    scored = ml.score(model, _prepared_of(rows, facts).where("extension = 'py'"))
    return report.select("n", "positives").crossJoin(
        rejects.agg(F.count(F.lit(1)).alias("n_rejects"))
    ).crossJoin(scored.agg(F.count_if(F.col("p1").between(0, 1)).alias("n_scored")))


@query
def model_suggestions(spark, sf_dir):
    """Model trained on the labelled lines, saved and loaded, and new pull requests scored with it.

    One row per request: its message, and whether its suggestions are at most
    seven, ranked from 1 without gaps, on lines that the patch changes, and the
    same with the model as it was before it was saved.
    """
    facts, rows = materialize(_facts(spark, sf_dir)), _stored(spark, sf_dir)
    labelled = label.labelled_lines(rows)
    prepared = features.prepare_training_data(labelled, facts, keep=("pull_request_url",))
    trained = ml.train_model(prepared, fast=True, **_TOY).model
    path = _fresh_path(spark, "model")
    trained.write().save(path)
    requests = rows.select("pull_request_url", "pull_patch_url")
    pages = V.responses(spark, sf_dir).where("status = 200")
    suggestions, answers = jobs.score_requests(requests, pages, facts, PipelineModel.load(path))
    again, _ = jobs.score_requests(requests, pages, facts, trained)
    there = V.changed(spark, sf_dir).select(
        "pull_request_url", "filename", "commit_id", F.col("position").alias("line"), F.lit(True).alias("there")
    ).distinct()
    key = ["pull_request_url", "filename", "commit_id", "line", "rank"]
    checked = (
        suggestions.select(*key, "message")
        .join(again.select(*key, F.col("message").alias("before")), key, "full")
        .join(there, key[:4], "left")
        .groupBy("pull_request_url")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("rank").alias("last"),
            F.countDistinct("rank").alias("ranks"),
            F.bool_and(F.coalesce("there", F.lit(False))).alias("there"),
            F.bool_and(F.coalesce(F.col("message") == F.col("before"), F.lit(False))).alias("same"),
        )
    )
    return answers.join(checked, "pull_request_url", "left").select(
        "pull_request_url",
        "message",
        (F.coalesce("n", F.lit(0)) == F.size("positions")).alias("all_listed"),
        (F.coalesce("n", F.lit(0)) <= score.MAX_SUGGESTIONS).alias("at_most_seven"),
        F.coalesce((F.col("last") == F.col("n")) & (F.col("ranks") == F.col("n")), F.lit(True)).alias("ranked"),
        F.coalesce("there", F.lit(True)).alias("lines_exist"),
        F.coalesce("same", F.lit(True)).alias("saved_agrees"),
    )


@query
def roc_and_pr_areas(spark, sf_dir):
    """Exact areas under both curves."""
    areas = metrics.areas(V.predictions(spark, sf_dir))
    return areas.select("n", "positives", F.round("roc", 9).alias("roc"), F.round("pr", 9).alias("pr"))


@query
def curve_points(spark, sf_dir):
    """True and false positives at every distinct score."""
    return metrics.curve_points(V.predictions(spark, sf_dir))


# -- suggestions -----------------------------------------------------------


@query
def positive_predictions(spark, sf_dir):
    return score.positive_predictions(V.predictions(spark, sf_dir))


@query
def best_per_line(spark, sf_dir):
    positive = score.positive_predictions(V.predictions(spark, sf_dir))
    return score.best_per_line(positive).select(score.PR, "filename", "line", "commit_id", "p1")


@query
def unplaced_predictions(spark, sf_dir):
    """Predictions that cannot be placed because they lack a commit."""
    best = score.best_per_line(score.positive_predictions(V.predictions(spark, sf_dir)))
    return score.split_unplaced(best)[1].select(score.PR, "filename", "line", "p1")


@query
def top_suggestions(spark, sf_dir):
    """At most seven lines per pull request."""
    return score.suggest(V.predictions(spark, sf_dir)).select(
        score.PR, "filename", "line", "commit_id", "p1", "rank"
    )


@query
def deduped_suggestions(spark, sf_dir):
    """Each (commit, file, position) once per pull request."""
    twice = V.predictions(spark, sf_dir).where("commit_id is not null").select(
        score.PR, "commit_id", "filename", F.col("offset").alias("line")
    )
    return score.dedupe_suggestions(twice)


@query
def suggestion_messages(spark, sf_dir):
    """Key and text of every suggestion."""
    suggestions = score.with_messages(score.suggest(V.predictions(spark, sf_dir)))
    key = score.suggestion_key(F.col("commit_id"), F.col("filename"), F.col("line"))
    return suggestions.select(score.PR, key.alias("suggestion_key"), "message")


@query
def document_messages(spark, sf_dir):
    """Message template over keys of all documents."""
    key = F.col("doc_id").cast("string")
    return V.table(spark, sf_dir, "documents").select("doc_id", suggestion_message(key).alias("message"))


def _by_hash(prepared: DataFrame) -> DataFrame:
    """A scorer that SQL can repeat."""
    p1 = V.unit_score(F.concat_ws(":", "pull_request_url", "filename", "offset"))
    return prepared.withColumns({"p1": p1, "prediction": (p1 >= 0.7).cast("double")})


def _shown_answers(answers: DataFrame) -> DataFrame:
    place = F.expr("transform(positions, p -> concat(p.filename, '@', p.commit_id, ':', p.position))")
    return answers.select("pull_request_url", shown(place).alias("positions"), "message")


@query
def scoring_responses(spark, sf_dir):
    """One response per request; failed requests carry a message."""
    requests = V.resolved(spark, sf_dir).select("pull_request_url", "pull_patch_url")
    pages = V.responses(spark, sf_dir).where("status = 200")
    _, answers = jobs.score_requests(requests, pages, _facts(spark, sf_dir), _by_hash)
    return _shown_answers(answers)


# -- debug dump, merged schemas --------------------------------------------


@query
def json_dump(spark, sf_dir):
    """The first fifty rows as JSON lines."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return sinks.dump_rows(docs, ["doc_id"])


@query
def json_dump_escaped(spark, sf_dir):
    """The dump written, read back and escaped."""
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    path = _fresh_path(spark, "dump")
    sinks.write_dump(docs, f"{path}/json", f"{path}/escaped", ["doc_id"])
    return spark.read.text(f"{path}/escaped")


@query
def merged_schemas(spark, sf_dir):
    """Two Parquet files with different columns read as one table."""
    path = _fresh_path(spark, "merged")
    df = V.patches(spark, sf_dir)
    df.where("patch_id % 2 = 0").write.parquet(f"{path}/part=0")
    df.where("patch_id % 2 = 1").withColumn("size", F.length("patch")).write.parquet(f"{path}/part=1")
    return tables.read_merged(spark, path).select("patch_id", "size")


# -- pull-request events ---------------------------------------------------


@query
def opened_pull_requests(spark, sf_dir):
    """Scoring requests of events that open a pull request."""
    decoded = stream.decode_events(V.pull_request_events(spark, sf_dir))
    return stream.opened_pull_requests(decoded).select(
        "pull_request_url", "pull_patch_url", "repo_name", "owner", "number", "title"
    )


@query
def rejected_events(spark, sf_dir):
    decoded = stream.decode_events(V.pull_request_events(spark, sf_dir))
    return stream.rejected_events(decoded).select("order_key", "value")


@query
def streamed_pull_requests(spark, sf_dir):
    """The same as a stream over files, run until all are read."""
    path = _fresh_path(spark, "events")
    V.pull_request_events(spark, sf_dir).select("value").write.text(f"{path}/in")
    texts = stream.read_event_texts(spark, f"{path}/in")
    for q in stream.start_event_log(texts, f"{path}/opened", f"{path}/rejects", f"{path}/state"):
        q.awaitTermination()
    return spark.read.parquet(f"{path}/opened").select(
        "pull_request_url", "pull_patch_url", "repo_name", "owner", "number", "title"
    )


def _scored_stream(spark, sf_dir, scorer, facts) -> str:
    """Events of pull requests scored as a stream of three micro-batches; the folder of the tables."""
    path = _fresh_path(spark, "scoring")
    V.pull_request_events(spark, sf_dir).select("value").repartition(3).write.text(f"{path}/in")
    texts = stream.read_event_texts(spark, f"{path}/in", max_files=1)
    pages = V.responses(spark, sf_dir).where("status = 200")
    jobs.score_events(texts, pages, facts, scorer, f"{path}/out", f"{path}/state").awaitTermination()
    return f"{path}/out"


@query
def streamed_suggestions(spark, sf_dir):
    """Every micro-batch of events scored with patches and facts; one answer per opened pull request."""
    out = _scored_stream(spark, sf_dir, _by_hash, _facts(spark, sf_dir))
    return _shown_answers(spark.read.parquet(f"{out}/answers"))


@query
def streamed_rejects(spark, sf_dir):
    """What the scoring stream could not decode."""
    out = _scored_stream(spark, sf_dir, _by_hash, _facts(spark, sf_dir))
    return spark.read.parquet(f"{out}/rejects").select("value")


@query
def streamed_dedupe(spark, sf_dir):
    """Repeated suggestions dropped from a stream whose watermark moves, and let in again when they are forgotten.

    Suggestions come at noon, again ten minutes later (dropped), those of other
    lines at six, which moves the watermark on, and the first ones once more at
    ten past six (let in) together with some of noon (too late).
    """
    path = _fresh_path(spark, "dedupe")
    rows = V.predictions(spark, sf_dir).where("commit_id is not null").select(
        score.PR, "commit_id", "filename", F.col("offset").alias("line")
    ).distinct()
    rows = materialize(rows)
    early, other = rows.where("line % 2 = 0"), rows.where("line % 2 = 1")

    def at(df, hour, minute):
        return df.withColumn("sent_at", F.lit(f"2024-01-01 {hour}:{minute:02}:00").cast("timestamp"))

    steps = (
        at(early, 12, 0), at(early, 12, 10), at(other, 18, 0),
        at(early, 18, 10).unionByName(at(other.where("line % 3 = 0"), 12, 0)),
    )
    late = 0
    for step in steps:
        step.write.mode("append").parquet(f"{path}/in")
        q = stream.start_dedupe(
            spark.readStream.schema(step.schema).parquet(f"{path}/in"), "sent_at", f"{path}/out", f"{path}/state"
        )
        q.awaitTermination()
        late += stream.late_rows(q)
    sent = F.date_format("sent_at", "HH:mm").alias("sent")
    kept = spark.read.parquet(f"{path}/out").select(score.PR, "commit_id", "filename", "line", sent)
    return kept.withColumn("n_late", F.lit(late).cast("bigint"))
