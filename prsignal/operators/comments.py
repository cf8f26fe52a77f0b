"""Review comments as a table of one row per comment.

Labels need the comments of a pull request wherever they were found: in one
nested row, in the rows of several days, or straight from the archive.  All of
these become rows of one form here.  Kept as a table they are clustered by
(pull request, file), so what is needed per file is summed up where it lies:
reading it for labels moves no comment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.functions.text import parse_int, strip_quotes
from prsignal.schemas import COMMENT

CLUSTERED_BY = ("pull_request_url", "filename")


def comments_of_rows(resolved: DataFrame, day: str | None = None) -> DataFrame:
    """The comments of nested rows, told apart by ``item``, their index in the row.

    The parallel arrays of a row need not be equally long: a comment has a hunk
    where the arrays of hunks, paths and texts all reach it, a position where
    those of positions and paths do.  ``day`` names the column that orders the
    rows of one pull request.
    """
    arrays = {
        "hunk": "diff_hunks",
        "filename": "comment_file_paths",
        "comment_text": "comment_text",
        "pos": "comment_positions",
        "commit_id": "comment_commit_ids",
    }
    filled = {name: F.coalesce(F.col("parsed_input")[c], F.array()) for name, c in arrays.items()}
    size = {name: F.size(a) for name, a in filled.items()}
    at = F.col("item")
    return (
        resolved.select(
            "pull_request_url",
            (F.col(day).cast("string") if day else F.lit("")).alias("day"),
            F.least(size["hunk"], size["filename"], size["comment_text"]).alias("n_hunks"),
            F.least(size["pos"], size["filename"]).alias("n_positions"),
            size["commit_id"].alias("n_commits"),
            F.posexplode(F.arrays_zip(*(a.alias(n) for n, a in filled.items()))).alias("item", "c"),
        )
        .select(
            "pull_request_url",
            "c.filename",
            "c.commit_id",
            F.col("c.pos.original_position").alias("original_position"),
            F.col("c.pos.new_position").alias("new_position"),
            "c.comment_text",
            "c.hunk",
            "day",
            at.cast("bigint").alias("item"),
            (at < F.col("n_hunks")).alias("has_hunk"),
            (at < F.col("n_positions")).alias("has_position"),
            (at < F.col("n_commits")).alias("has_commit"),
        )
    )


def comments_of_events(comments: DataFrame) -> DataFrame:
    """Review comments of the archive (with their ``day``) as rows, told apart by their event."""
    known = F.col("pull_request_url") != "null"
    return comments.where(known).select(
        strip_quotes(F.col("pull_request_url")).alias("pull_request_url"),
        F.col("path").alias("filename"),
        "commit_id",
        parse_int(F.col("original_position")).alias("original_position"),
        parse_int(F.col("position")).alias("new_position"),
        F.coalesce("body", F.lit("")).alias("comment_text"),
        F.col("diff_hunk").alias("hunk"),
        "day",
        F.col("event_id").cast("bigint").alias("item"),
        (F.col("diff_hunk").isNotNull() & F.col("path").isNotNull()).alias("has_hunk"),
        F.col("path").isNotNull().alias("has_position"),
        F.col("commit_id").isNotNull().alias("has_commit"),
    )


def attach_comments(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """The clustered table at ``path`` (empty where there is none yet) under ``name`` in this session's catalog."""
    keys = ", ".join(CLUSTERED_BY)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({COMMENT}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def add_comments(comments: DataFrame, name: str) -> None:
    """Add rows to a clustered table.

    The rebalance brings the rows of a file together and splits a pull request
    that holds a large share of all comments over several tasks.
    """
    table = comments.sparkSession.table(name)
    comments.select(*table.columns).hint("rebalance", *CLUSTERED_BY).write.insertInto(name)


def file_marks(comments: DataFrame) -> DataFrame:
    """(pull_request_url, filename, points, hits): per file the positions that comments have.

    ``points`` are positions on any commit, ``hits`` those with their commit,
    each once, so a file that very many comments point at has no more of them
    than it has positions.  On a clustered table nothing is moved for this.
    """
    spots = F.explode(F.array("original_position", "new_position"))
    hit = F.when(F.col("has_commit"), F.struct("commit_id", "at"))
    return (
        comments.where("has_position AND filename IS NOT NULL")
        .select(*CLUSTERED_BY, "commit_id", "has_commit", spots.alias("at"))
        .where("at IS NOT NULL")
        .groupBy(*CLUSTERED_BY)
        .agg(F.collect_set("at").alias("points"), F.collect_set(hit).alias("hits"))
    )
