"""Extracts from the event archive: review comments per pull request, opened issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prsignal.functions.arrays import compute_once
from prsignal.functions.text import bucket_of, drop_quotes
from prsignal.schemas import EVENT_PAYLOAD

# Event types and the stand-in for a missing position.
REVIEW_EVENT_TYPES = ("PullRequestReviewCommentEvent", "PullRequestEvent2")
ISSUE_EVENT_TYPE = "IssuesEvent"
OPENED = "opened"
NO_POSITION = "-1"

_CORRUPT = "_corrupt"


def decode_payload(events: DataFrame, schema: str = EVENT_PAYLOAD) -> DataFrame:
    """Parse the JSON payload once; ``p`` holds its fields, ``p._corrupt`` what did not parse."""
    options = f"map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '{_CORRUPT}')"
    return compute_once(events, p=f"from_json(payload, '{schema}, {_CORRUPT} string', {options})")


def split_undecodable(
    events: DataFrame, schema: str = EVENT_PAYLOAD
) -> tuple[DataFrame, DataFrame]:
    """(events with the decoded payload ``p``, events whose payload is missing or not JSON)."""
    decoded = decode_payload(events, schema)
    bad = F.col("payload").isNull() | F.col(f"p.{_CORRUPT}").isNotNull()
    return decoded.where(~bad), decoded.where(bad).drop("p")


def review_events(events: DataFrame) -> DataFrame:
    return events.where(F.col("type").isin(*REVIEW_EVENT_TYPES))


def review_comments(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per review event that names a pull request.

    Missing positions become "-1"; undecodable payloads are skipped.  ``keep``
    names columns of the events to carry along, such as the day.
    """
    ok, _ = split_undecodable(review_events(events))
    comment = F.col("p.comment")
    return ok.select(
        *keep,
        "event_id",
        F.col("p.action").alias("action"),
        F.col("p.pull_request.url").alias("pull_request_url"),
        F.col("p.pull_request.patch_url").alias("pull_patch_url"),
        F.coalesce(comment["original_position"], F.lit(NO_POSITION)).alias("original_position"),
        F.coalesce(comment["position"], F.lit(NO_POSITION)).alias("position"),
        comment["commit_id"].alias("commit_id"),
        comment["path"].alias("path"),
        comment["body"].alias("body"),
        comment["diff_hunk"].alias("diff_hunk"),
        comment["created_at"].alias("created_at"),
    ).where(F.col("pull_request_url").isNotNull())


def _with_part(comments: DataFrame, keys: Sequence[str], max_comments: int | None) -> DataFrame:
    """Number the output row of each comment: 0, unless a pull request has too many."""
    if max_comments is None:
        return comments.withColumn("part", F.lit(0))
    hot = (
        comments.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > max_comments)
        .select(*keys, F.ceil(F.col("n") / max_comments).alias("parts"))
    )
    return comments.join(hot, list(keys), "left").withColumn(
        "part",
        F.coalesce(bucket_of(F.col("event_id").cast("string"), F.col("parts")), F.lit(0)).cast("int"),
    )


def comments_by_pull_request(
    comments: DataFrame,
    max_comments: int | None = None,
    keys: Sequence[str] = ("pull_request_url",),
) -> DataFrame:
    """One row per pull request with its comments as aligned arrays, by event id.

    ``keys`` may add a day, which gives one row per pull request and day.  With
    ``max_comments`` a pull request that has more is spread over several rows
    (``part`` 0, 1, ...).  This is the form of the CSV extract; the jobs keep one
    row per comment, see ``comments.py``, and gather nothing.
    """
    by_event = F.array_sort(
        F.collect_list(
            F.struct("event_id", "position", "original_position", "commit_id", "path", "body",
                     "diff_hunk")
        )
    )
    grouped = (
        _with_part(comments, keys, max_comments)
        .groupBy(*keys, "part")
        .agg(
            F.min("pull_patch_url").alias("pull_patch_url"),
            F.min("created_at").alias("created_date"),
            by_event.alias("c"),
        )
    )

    def field(name: str) -> Column:
        return F.transform("c", lambda c: c[name])

    return grouped.select(
        *keys,
        "part",
        "pull_patch_url",
        "created_date",
        field("position").alias("comments_positions"),
        field("original_position").alias("comments_original_positions"),
        field("commit_id").alias("comment_commit_ids"),
        field("path").alias("comment_file_paths"),
        field("body").alias("comment_text"),
        field("diff_hunk").alias("diff_hunks"),
    )


def drop_null_items(array: Column) -> Column:
    """The array without its nulls, as an aggregate that ignores nulls would give it."""
    return F.filter(array, lambda item: item.isNotNull())


def comment_cells(grouped: DataFrame) -> DataFrame:
    """The CSV form of :func:`comments_by_pull_request`.

    Positions and commits are joined with blanks, paths become a JSON array
    (``null`` when there is none).
    """
    commits = drop_null_items(F.col("comment_commit_ids"))
    paths = drop_null_items(F.col("comment_file_paths"))
    return grouped.select(
        drop_quotes(F.col("pull_request_url")).alias("pull_request_url"),
        drop_quotes(F.col("pull_patch_url")).alias("pull_patch_url"),
        F.array_join("comments_positions", " ").alias("comments_positions_space_delimited"),
        F.array_join("comments_original_positions", " ").alias(
            "comments_original_positions_space_delimited"
        ),
        F.when(F.size(paths) > 0, F.to_json(paths))
        .otherwise("null")
        .alias("comment_file_paths_json_encoded"),
        F.array_join(commits, " ").alias("comment_commit_ids_space_delimited"),
    )


def to_raw_comments(grouped: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The nested form that the ingest job reads, with the columns of ``keep``."""
    positions = F.zip_with(
        "comments_original_positions",
        "comments_positions",
        lambda old, new: F.create_map(
            F.lit("original_position"), old, F.lit("new_position"), new
        ),
    )
    return grouped.select(
        *keep,
        "pull_patch_url",
        "created_date",
        "pull_request_url",
        positions.alias("comment_positions"),
        "comment_text",
        F.transform("diff_hunks", _json_literal).alias("diff_hunks"),
        "comment_commit_ids",
        "comment_file_paths",
    )


def _json_literal(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(array, F.lit(2), F.length(array) - 2))


def opened_issues(events: DataFrame) -> DataFrame:
    """(name, url) of the issues that were opened."""
    ok, _ = split_undecodable(events.where(F.col("type") == ISSUE_EVENT_TYPE))
    return ok.where(F.col("p.action") == OPENED).select(
        F.col("repo.name").alias("name"), F.col("p.issue.url").alias("url")
    )


def limit_cells(cells: DataFrame, n: int = -1, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` cells in a fixed order; -1 keeps all."""
    if n == -1:
        return cells
    return cells.orderBy(*(order_by or cells.columns)).limit(n)
