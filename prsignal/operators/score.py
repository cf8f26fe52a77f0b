"""From predictions to a small ranked set of suggested lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prsignal.functions.messages import suggestion_message

# Fixed value: suggestions per pull request.
MAX_SUGGESTIONS = 7

PR = "pull_request_url"


def positive_only(scored: DataFrame) -> DataFrame:
    """Positive predictions; ``p1`` is the probability of the positive class."""
    return scored.where(F.col("prediction") == 1.0).select(
        PR, "filename", F.col("offset").alias("line"), "commit_id", "p1", "prediction"
    )


def positive_predictions(scored: DataFrame) -> DataFrame:
    """Positive predictions, each once."""
    return positive_only(scored).distinct()


def best_per_line(positive: DataFrame) -> DataFrame:
    """One prediction per line: the one with the highest probability.

    Repeated predictions do not matter here, so they need not be made distinct first.
    """
    return positive.groupBy(PR, "filename", "line", "commit_id").agg(
        F.max("prediction").alias("prediction"), F.max("p1").alias("p1")
    )


def split_unplaced(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with commit and position, lines that lack one and cannot be suggested)."""
    placed = F.col("commit_id").isNotNull() & F.col("line").isNotNull()
    return lines.where(placed), lines.where(~placed)


def top_suggestions(lines: DataFrame, n: int = MAX_SUGGESTIONS) -> DataFrame:
    """The ``n`` most probable lines of each pull request, with their ``rank``.

    Spark drops lines beyond the n-th before the shuffle as well, so a pull
    request with very many lines sends at most ``n`` per task.
    """
    window = Window.partitionBy(PR).orderBy(
        F.col("p1").desc(), "filename", "line", "commit_id"
    )
    return lines.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def suggestion_key(commit_id: Column, filename: Column, position: Column) -> Column:
    """The text key of a suggestion: commit, file and position run together."""
    return F.concat(commit_id, filename, position.cast("string"))


def dedupe_suggestions(suggestions: DataFrame) -> DataFrame:
    """Each (commit, file, position) once per pull request.

    The fields are compared one by one; run together they could collide.
    """
    return suggestions.dropDuplicates([PR, "commit_id", "filename", "line"])


def with_messages(suggestions: DataFrame, name: str = "Reviewer") -> DataFrame:
    """Add the text of the suggestion."""
    key = suggestion_key(F.col("commit_id"), F.col("filename"), F.col("line"))
    return suggestions.withColumn("message", suggestion_message(key, name))


def responses(requests: DataFrame, suggestions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row per request with its suggestions by rank and an error message, if any.

    The list of a request has at most ``MAX_SUGGESTIONS`` items.  Requests that
    failed stay in the result with an empty list.
    """
    lists = suggestions.groupBy(PR).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "filename", "commit_id", "line"))),
            lambda s: F.struct(
                s["filename"].alias("filename"),
                s["commit_id"].alias("commit_id"),
                s["line"].alias("position"),
            ),
        ).alias("positions")
    )
    out = requests.select(PR).distinct().join(lists, PR, "left")
    if errors is not None:
        first = errors.groupBy(PR).agg(F.min("error").alias("message"))
        out = out.join(first, PR, "left")
    else:
        out = out.withColumn("message", F.lit(None).cast("string"))
    empty = F.array().cast("array<struct<filename:string,commit_id:string,position:int>>")
    return out.select(PR, F.coalesce("positions", empty).alias("positions"), "message")


def suggest(scored: DataFrame, n: int = MAX_SUGGESTIONS) -> DataFrame:
    """Scored lines to ranked suggestions: positives, one per line, top ``n``."""
    placed, _ = split_unplaced(best_per_line(positive_only(scored)))
    return top_suggestions(placed, n)
