"""Writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.schemas import LEDGER
from prsignal.sources.archive import missing_days
from prsignal.sources.tables import read_or_empty

# Column order of the two CSV extracts.
COMMENT_CSV_HEADER = (
    "pull_request_url",
    "pull_patch_url",
    "comments_positions_space_delimited",
    "comments_original_positions_space_delimited",
    "comment_file_paths_json_encoded",
    "comment_commit_ids_space_delimited",
)
ISSUE_CSV_HEADER = ("name", "url")
# Fixed value: rows of a debug dump.
DUMP_ROWS = 50


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_issue_facts(facts: DataFrame, path: str) -> None:
    """Overwrite the facts, in one folder per project.

    The rebalance keeps a project's rows together where they are few and splits
    a project that holds a large share of them over several tasks and files.
    """
    (
        facts.hint("rebalance", "project")
        .sortWithinPartitions("project", "filename", "line")
        .write.partitionBy("project")
        .mode("overwrite")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, header: Sequence[str], mode: str = "overwrite") -> None:
    """CSV with a header, columns by name in the order of ``header``, quotes doubled."""
    (
        df.select(*header)
        .write.mode(mode)
        .options(header=True, quote='"', escape='"', emptyValue="", nullValue="")
        .csv(path)
    )


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (n_rows, content_id) that does not depend on row order or layout.

    The content id is the sum of the first 32 bits of every row's md5.
    """
    columns = list(columns or df.columns)
    # A null and an empty text differ, as do ("a", "bc") and ("ab", "c").
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    row = F.md5(F.concat_ws("\x1f", *fields))
    bits = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
    return df.select(bits.alias("bits")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("bits"), F.lit(0)).alias("content_id")
    )


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row."""
    report.coalesce(1).write.json(path)


def dump_rows(df: DataFrame, order_by: Sequence[str | Column], n: int = DUMP_ROWS) -> DataFrame:
    """The first ``n`` rows as JSON lines in a column ``value``."""
    return df.orderBy(*order_by).limit(n).select(F.to_json(F.struct("*")).alias("value"))


def escape_lines(lines: DataFrame) -> DataFrame:
    """Each line as a quoted, escaped literal."""
    wrapped = F.to_json(F.struct(F.col("value").alias("v")))
    literal = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    return lines.select(F.coalesce(literal, F.lit('""')).alias("value"))


def write_dump(
    df: DataFrame, path: str, escaped_path: str, order_by: Sequence[str | Column], n: int = DUMP_ROWS
) -> None:
    """Debug dump: JSON lines, and the same lines as escaped literals."""
    dump_rows(df, order_by, n).write.text(path)
    escape_lines(df.sparkSession.read.text(path)).write.text(escaped_path)


def write_rejects(rejects: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rejects.write.mode(mode).json(path)


def ledger_path(path: str) -> str:
    """Where the finished days of the table at ``path`` are written down; readers of the table skip this folder."""
    return f"{path}/_ledger"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(day, n_rows, run) of the days that are finished at ``path``, those without rows too."""
    return read_or_empty(spark, ledger_path(path), LEDGER)


def ingest_missing_days(
    spark: SparkSession,
    extract: Callable[[Sequence[str]], DataFrame],
    days: Sequence[str],
    path: str,
    run: str = "",
) -> list[str]:
    """Write the days that are not finished at ``path`` yet, one partition per day, in one job.

    ``extract(days)`` gives the rows of these days with their ``day``.  When the
    rows are written, the days are entered in a ledger, with the number of their
    rows, so a day without any is finished too.  A run that failed half way has
    no entry; the next one writes its days again and overwrites what is there.
    Returns the days it wrote.
    """
    requested = spark.createDataFrame([(d,) for d in days], "day string")
    # As many rows as days were asked for.
    todo = sorted(r.day for r in missing_days(requested, read_ledger(spark, path)).collect())
    if todo:
        rows = extract(todo)
        (
            rows.write.partitionBy("day")
            .option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .parquet(path)
        )
        written = read_or_empty(spark, path, rows.schema).where(F.col("day").isin(todo))
        counts = written.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"))
        finished = (
            spark.createDataFrame([(d,) for d in todo], "day string")
            .join(counts, "day", "left")
            .select("day", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(run).alias("run"))
        )
        append_parquet(finished.coalesce(1), ledger_path(path))
    return todo
