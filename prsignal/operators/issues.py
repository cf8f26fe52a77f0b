"""Stack-trace facts from issue texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prsignal.functions.text import stack_frames


def issue_facts(issues: DataFrame, dedupe: bool = True) -> DataFrame:
    """(project, filename, line) of every stack frame in (name, body) rows.

    With ``dedupe=False`` a frame that is quoted twice gives two rows.  Frames
    whose line number does not fit an int are left out; see
    :func:`overlong_frames`.
    """
    facts = _frames(issues).where(F.col("line").isNotNull())
    return facts.distinct() if dedupe else facts


def overlong_frames(issues: DataFrame) -> DataFrame:
    """(project, filename) of the frames whose line number does not fit an int."""
    return _frames(issues).where(F.col("line").isNull()).select("project", "filename")


def _frames(issues: DataFrame) -> DataFrame:
    return issues.select(
        F.col("name").alias("project"), F.inline(stack_frames(F.col("body")))
    ).select("project", "filename", "line")
