"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prsignal import schemas


def read_parquet(
    spark: SparkSession, path: str, schema: StructType | str | None = None, partitions: int | None = None
) -> DataFrame:
    """Parquet with a fixed schema.

    ``partitions`` redistributes rows that sit in a few large files; by default
    the scan's own splits are kept, which costs no shuffle.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.repartition(partitions) if partitions else df


def read_comments(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    return read_parquet(spark, path, schemas.RAW_COMMENTS, partitions)


def comments_from_json(df: DataFrame, col: str = "value") -> DataFrame:
    """Raw comment rows from a column of JSON texts (an object, or an array of objects)."""
    rows = F.from_json(F.col(col), f"array<struct<{schemas.RAW_COMMENTS}>>")
    return df.select(F.inline(rows))


def read_issue_inputs(
    spark: SparkSession, path: str, format: str = "parquet", partitions: int | None = None
) -> DataFrame:
    """(name, url) rows from Parquet, or from CSV with a header and doubled quotes."""
    reader = spark.read.schema(schemas.ISSUE_INPUT)
    if format == "csv":
        df = reader.csv(path, header=True, quote='"', escape='"', enforceSchema=False)
    elif format == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unknown format {format!r}")
    return df.repartition(partitions) if partitions else df


def issue_inputs_from_csv(df: DataFrame, col: str = "value") -> DataFrame:
    """(name, url) rows from a column of CSV lines."""
    options = {"quote": '"', "escape": '"'}
    row = F.from_csv(F.col(col), F.lit(schemas.ISSUE_INPUT), options)
    return df.select(row.alias("r")).select("r.*").where((F.col("name") != "name") | (F.col("url") != "url"))


def read_or_empty(spark: SparkSession, path: str | None, schema: StructType | str) -> DataFrame:
    """The table at ``path``, or no rows when nothing has been written there yet.

    Any other error (unreadable files, wrong credentials) is raised.
    """
    if path is not None:
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    return read_or_empty(spark, path, schemas.STORED_PATCH)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Parquet whose files have different, compatible schemas."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_issue_facts(spark: SparkSession, path: str) -> DataFrame:
    """Stack-trace facts, partitioned by project, so that a filter on project prunes files."""
    return spark.read.schema(schemas.ISSUE_FACT).parquet(path)


def read_resolved(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    return read_parquet(spark, path, schemas.RESOLVED, partitions)
