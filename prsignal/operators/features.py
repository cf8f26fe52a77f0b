"""Features of changed lines; the same expressions for training and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prsignal.functions.text import basename, extension, only_spaces, project_of

PREPARED_COLUMNS = (
    "previous_lines",
    "line_text",
    "next_lines",
    "filename",
    "is_added",
    "commented",
    "extension",
    "line_length",
    "label",
    "only_spaces",
    "not_in_issues",
    "commit_id",
    "offset",
)


def line_features(text: Column, filename: Column, compat: bool = False) -> dict[str, Column]:
    """Features that need nothing but the line and its file name."""
    return {
        "extension": extension(filename),
        "line_length": F.length(text).cast("double"),
        "only_spaces": only_spaces(text, compat).cast("double"),
    }


def facts_of_projects(facts: DataFrame, projects: DataFrame) -> DataFrame:
    """The facts of some projects.

    Where facts are kept in folders by project, the projects are looked up
    first and only their folders are read.  (Spark adds this filter at run time
    where the side that is looked up has a comparison of its own.)
    """
    wanted = projects.select("project").where(F.col("project") > "").distinct()
    return facts.join(wanted, "project", "left_semi")


def with_issue_marker(lines: DataFrame, facts: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Add ``not_in_issues``: 1.0 unless a stack frame of the project names the line.

    The key is (project, last part of the file name, line).  Facts are reduced
    to distinct keys first, so no line is duplicated, and to ``projects``, those
    of the lines, where they are given.  Which join is used, and how a key that
    many lines share is split, is left to adaptive execution.
    """
    if projects is not None:
        facts = facts_of_projects(facts, projects)
    keys = (
        facts.select(
            "project", basename(F.col("filename")).alias("basename"), "line", F.lit(True).alias("hit")
        )
    ).distinct()
    return (
        lines.withColumn("basename", basename(F.col("filename")))
        .join(keys, ["project", "basename", "line"], "left")
        .withColumn("not_in_issues", F.col("hit").isNull().cast("double"))
        .drop("hit", "basename")
    )


def with_issue_fan_out(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """The older form of :func:`with_issue_marker`: any project, and a line counts once per matching fact.

    ``copies`` says how often a line counts.  Facts are counted per key before
    the join, so a file name that very many facts share multiplies nothing.
    """
    counted = facts.groupBy(basename(F.col("filename")).alias("basename"), "line").agg(
        F.count(F.lit(1)).alias("copies")
    )
    return (
        lines.withColumn("basename", basename(F.col("filename")))
        .join(counted, ["basename", "line"], "left")
        .withColumn("not_in_issues", F.col("copies").isNull().cast("double"))
        .withColumn("copies", F.coalesce("copies", F.lit(1)))
        .drop("basename")
    )


def prepare_training_data(
    labelled: DataFrame,
    facts: DataFrame,
    py_only: bool = True,
    compat: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Prepared rows of labelled lines; ``keep`` names further columns to carry along.

    With ``compat`` they have ``copies``, how often a row counts in training.
    """
    features = line_features(F.col("line_text"), F.col("filename"), compat)
    lines = labelled.withColumn("extension", features["extension"])
    if py_only:
        # The extension depends on the line alone, so the filter runs before the join.
        lines = lines.where(F.col("extension") == "py")
    if compat:
        joined, keep = with_issue_fan_out(lines, facts), (*keep, "copies")
    else:
        joined = with_issue_marker(
            lines.withColumn("project", project_of(F.col("pull_request_url"))), facts
        )
    return joined.select(
        *keep,
        "previous_lines",
        "line_text",
        "next_lines",
        "filename",
        "is_added",
        F.col("commented").cast("double").alias("commented"),
        "extension",
        features["line_length"].alias("line_length"),
        F.col("commented").cast("double").alias("label"),
        features["only_spaces"].alias("only_spaces"),
        "not_in_issues",
        "commit_id",
        "offset",
    )


def prepare_scoring_data(
    lines: DataFrame,
    facts: DataFrame,
    keep: tuple[str, ...] = ("pull_request_url",),
    projects: DataFrame | None = None,
) -> DataFrame:
    """Prepared rows of the changed lines of new pull requests.

    ``lines`` is the output of the patch parser with a ``project`` column;
    ``projects`` are the projects that may occur in it.
    """
    features = line_features(F.col("text"), F.col("filename"))
    joined = with_issue_marker(lines.withColumn("line", F.col("old_pos")), facts, projects)
    return joined.select(
        *keep,
        "previous_lines",
        F.col("text").alias("line_text"),
        "next_lines",
        "filename",
        "is_added",
        F.lit(0.0).alias("commented"),
        features["extension"].alias("extension"),
        features["line_length"].alias("line_length"),
        F.lit(0.0).alias("label"),
        features["only_spaces"].alias("only_spaces"),
        "not_in_issues",
        "commit_id",
        F.col("position").alias("offset"),
    )
