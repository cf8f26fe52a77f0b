"""Streams: pull-request events in, suggestions out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prsignal.functions.arrays import compute_once
from prsignal.schemas import PULL_REQUEST_EVENT
from prsignal.session import materialize, scratch
from prsignal.sources.sinks import ingest_missing_days

OPENED = "opened"


def read_event_texts(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of JSON texts, one event per line, from files that arrive at ``path``."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def decode_events(texts: DataFrame, col: str = "value") -> DataFrame:
    """Event texts with decoded fields ``e``; works on streams and on batches."""
    return compute_once(texts, e=f"from_json(`{col}`, '{PULL_REQUEST_EVENT}')")


def _has_action() -> Column:
    return F.col("e").isNotNull() & F.col("e.action").isNotNull()


def _opens() -> Column:
    return _has_action() & (F.col("e.action") == OPENED)


def opened_pull_requests(decoded: DataFrame) -> DataFrame:
    """Scoring requests of the events that open a pull request."""
    others = [c for c in decoded.columns if c != "e"]
    return decoded.where(_opens()).select(
        F.col("e.pull_request.url").alias("pull_request_url"),
        F.col("e.pull_request.patch_url").alias("pull_patch_url"),
        F.coalesce("e.repository.full_name", "e.repository.name").alias("repo_name"),
        F.col("e.repository.owner.login").alias("owner"),
        F.coalesce("e.pull_request.number", "e.number").alias("number"),
        F.col("e.pull_request.title").alias("title"),
        *others,
    )


def rejected_events(decoded: DataFrame) -> DataFrame:
    """Events that are not JSON or name no action."""
    return decoded.where(~_has_action()).drop("e")


def dedupe_stream(
    suggestions: DataFrame, event_time: str, delay: str = "1 hour", pr: str = "pull_request_url"
) -> DataFrame:
    """Each (commit, file, position) of a pull request once within ``delay``."""
    return suggestions.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(
        [pr, "commit_id", "filename", "line"]
    )


def start_dedupe(
    suggestions: DataFrame, event_time: str, output: str, checkpoint: str, delay: str = "1 hour"
) -> StreamingQuery:
    """:func:`dedupe_stream` of all that has come, appended to ``output``; what it has seen is in ``checkpoint``."""
    return (
        dedupe_stream(suggestions, event_time, delay)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a run left out because they were older than its watermark."""
    return sum(
        int(state["numRowsDroppedByWatermark"])
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )


def _overwrite_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch to its own folder, again if it was there: a batch that is repeated changes nothing."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def start_scoring(
    texts: DataFrame,
    score: Callable[[DataFrame], dict[str, DataFrame]],
    output: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score the opened pull requests of every micro-batch and write what comes of it.

    ``score(requests)`` gives the rows of tables by name; each goes to a table of
    that name below ``output``, and events that can't be decoded go to ``rejects``
    there.  All lines of a pull request come from one event, so a batch holds
    every line its ranking needs.  A batch that is run again after a failure
    overwrites its own folders, so every table has each batch once.  The
    batch's events are decoded once, and those that its tables need are kept.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            decoded = materialize(decode_events(batch).where(_opens() | ~_has_action()))
            tables = {"rejects": rejected_events(decoded), **score(opened_pull_requests(decoded))}
            for name, rows in tables.items():
                _overwrite_batch(rows, f"{output}/{name}", batch_id)

    writer = texts.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_daily_ingest(
    requested: DataFrame,
    extract: Callable[[Sequence[str]], DataFrame],
    path: str,
    checkpoint: str,
    col: str = "value",
) -> StreamingQuery:
    """Ingest the days that a stream of requests names and that are not finished yet.

    One run takes all requests that have come since the last and ends, so it can
    be started every few minutes.  The ledger at ``path`` says what is
    finished; a batch that is repeated finds its days there.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        # As many rows as days were asked for.
        days = sorted(r.day for r in batch.select(F.trim(col).alias("day")).where("day != ''").distinct().collect())
        ingest_missing_days(batch.sparkSession, extract, days, path, run=str(batch_id))

    return (
        requested.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_event_log(
    texts: DataFrame, output: str, rejects: str, checkpoint: str, available_now: bool = True
) -> list[StreamingQuery]:
    """Append opened pull requests and rejected events to two tables."""
    decoded = decode_events(texts)
    queries = []
    for df, path, name in (
        (opened_pull_requests(decoded), output, "opened"),
        (rejected_events(decoded), rejects, "rejects"),
    ):
        writer = (
            df.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .option("path", path)
        )
        if available_now:
            writer = writer.trigger(availableNow=True)
        queries.append(writer.start())
    return queries
