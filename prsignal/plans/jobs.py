"""The end-to-end jobs, from paths to paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prsignal.functions.arrays import compute_once
from prsignal.functions.text import project_of
from prsignal.operators import model as M
from prsignal.operators.clean import clean_comments
from prsignal.operators.comments import add_comments, attach_comments, comments_of_events
from prsignal.operators.extract import review_comments
from prsignal.operators.features import prepare_scoring_data
from prsignal.operators.issues import issue_facts
from prsignal.operators.patch import changed_lines, file_sections, rejected_patches, split_rejects
from prsignal.operators.resolve import fetch_and_store, resolve_issues
from prsignal.operators.score import (
    best_per_line,
    dedupe_suggestions,
    positive_only,
    responses,
    split_unplaced,
    top_suggestions,
    with_messages,
)
from prsignal.schemas import COMMENT
from prsignal.session import materialize, scratch
from prsignal.sources.archive import read_archive
from prsignal.sources.sinks import ingest_missing_days, write_issue_facts, write_rejects, write_report
from prsignal.sources.tables import (
    read_cache,
    read_comments,
    read_issue_facts,
    read_issue_inputs,
    read_resolved,
)
from prsignal.streaming.events import read_event_texts, start_daily_ingest, start_scoring


def _extract_days(events: DataFrame) -> Callable[[Sequence[str]], DataFrame]:
    def extract(days: Sequence[str]) -> DataFrame:
        comments = review_comments(events.where(F.col("day").isin(list(days))), keep=["day"])
        return comments_of_events(comments)

    return extract


def extract_comments(spark: SparkSession, archive: str, days: list[str], output: str) -> list[str]:
    """Daily extract of review comments, one row each; days that are finished already are skipped."""
    return ingest_missing_days(spark, _extract_days(read_archive(spark, archive)), days, output)


def follow_days(spark: SparkSession, archive: str, requested: str, output: str, checkpoint: str) -> None:
    """:func:`extract_comments` for all days that the files at ``requested`` (one day a line) name and no run has seen."""
    extract = _extract_days(read_archive(spark, archive))
    start_daily_ingest(read_event_texts(spark, requested), extract, output, checkpoint).awaitTermination()


def label_store(
    spark: SparkSession, comments: str, days: Sequence[str], table: str, path: str, buckets: int
) -> DataFrame:
    """Days of the comment extract added to the table that is clustered by pull request and file."""
    clustered = attach_comments(spark, table, path, buckets)
    add_comments(spark.read.schema(COMMENT).parquet(comments).where(F.col("day").isin(list(days))), table)
    return clustered


def ingest_comments(
    spark: SparkSession, comments: str, responses: DataFrame, output: str, cache: str | None = None
) -> None:
    """Clean raw comments, give each its patch, append what is new to results and cache."""
    cleaned = clean_comments(read_comments(spark, comments))
    with scratch(spark):
        fetch_and_store(cleaned, read_cache(spark, cache), responses, output, cache)


def mine_issues(
    spark: SparkSession,
    issues: str,
    responses: DataFrame,
    output: str,
    format: str = "parquet",
    dedupe: bool = True,
) -> None:
    """Stack-trace facts of opened issues, one folder per project."""
    inputs = read_issue_inputs(spark, issues, format)
    write_issue_facts(issue_facts(resolve_issues(inputs, responses), dedupe), output)


def train(
    spark: SparkSession, resolved: str, facts: str, output: str, prep_store: str, **options
) -> DataFrame:
    """Train, save the model (fails where one is saved already), write rejected patches and the report."""
    rows = read_resolved(spark, resolved)
    with scratch(spark):
        trained, report = M.train_and_evaluate(rows, read_issue_facts(spark, facts), prep_store, **options)
        write_rejects(rejected_patches(rows.where("patch IS NOT NULL")), f"{output}/rejects")
        trained.write().save(f"{output}/model")
        write_report(report, f"{output}/effectiveness")
    return report


def score_requests(
    requests: DataFrame,
    patches: DataFrame,
    facts: DataFrame,
    scorer: PipelineModel | Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Suggestions for new pull requests: (suggested lines, one response row per request).

    ``requests`` has pull_request_url and pull_patch_url, ``patches`` is a
    response table.  A request whose patch is missing or cannot be parsed gets
    a message instead of suggestions.  All requests are scored in one batch, and
    once: the positive lines are kept for the two results, and with them the
    errors, so that texts move once for both.  Of the facts only those of the
    requests' projects are read.
    """
    joined = requests.join(
        patches.select(F.col("url").alias("pull_patch_url"), F.col("body").alias("patch")),
        "pull_patch_url",
        "left",
    )
    # Both readers of the texts stand on this step, below which no filter of one alone gets: they share the join.
    joined = compute_once(joined, text="patch").selectExpr("pull_request_url", "text AS patch")
    bad = split_rejects(joined)[1].select("pull_request_url", "error")
    lines = changed_lines(file_sections(joined)).withColumn(
        "project", project_of(F.col("pull_request_url"))
    )
    projects = requests.select(project_of(F.col("pull_request_url")).alias("project"))
    prepared = prepare_scoring_data(lines, facts, projects=projects)
    scored = scorer(prepared) if callable(scorer) else M.score(scorer, prepared)
    found = materialize(best_per_line(positive_only(scored)).unionByName(bad, allowMissingColumns=True))
    placed, unplaced = split_unplaced(found.where("error IS NULL").drop("error"))
    suggestions = with_messages(dedupe_suggestions(top_suggestions(placed)))
    errors = found.where("error IS NOT NULL").select("pull_request_url", "error").unionByName(
        unplaced.select("pull_request_url", F.lit("line without a commit").alias("error"))
    )
    return suggestions, responses(requests, suggestions, errors)


def score_events(
    texts: DataFrame,
    patches: DataFrame,
    facts: DataFrame,
    scorer: PipelineModel | Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """A stream of pull-request events to suggestions, answers and rejects, in three tables below ``output``.

    Every micro-batch is scored as :func:`score_requests` scores a batch.
    """

    def score(requests: DataFrame) -> dict[str, DataFrame]:
        suggestions, answers = score_requests(requests, patches, facts, scorer)
        return {"suggestions": suggestions, "answers": answers}

    return start_scoring(texts, score, output, checkpoint, available_now)
