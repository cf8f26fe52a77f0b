"""Splitting, balancing and summing up training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prsignal.functions.text import bucket_of

_BUCKETS = 1000


def split_by_key(
    df: DataFrame, key: str = "pull_request_url", train: float = 0.9
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by hash of ``key``, so that all rows of a key are on one side.

    Unlike a random split the result does not depend on layout or order.
    """
    bucket = bucket_of(F.col(key), _BUCKETS)
    cut = round(train * _BUCKETS)
    return df.where(bucket < cut), df.where(~(bucket < cut))


def _copies(df: DataFrame) -> Column:
    """How often a row counts: its ``copies``, if there is such a column."""
    return F.col("copies") if "copies" in df.columns else F.lit(1)


def summarize(df: DataFrame) -> DataFrame:
    """One row: number of rows and of positives, with their ``copies`` if they have any."""
    n = _copies(df).cast("bigint")
    return df.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("label").cast("bigint") * n), F.lit(0)).alias("positives"),
    )


def _times(df: DataFrame, ratio_basis: str) -> Column:
    """How often a positive counts, as an uncorrelated scalar subquery: two numbers, computed once, no join."""
    if ratio_basis not in ("total", "negatives"):
        raise ValueError(f"unknown ratio basis {ratio_basis!r}")
    copies = _copies(df).cast("bigint")
    positives = F.sum((F.col("label") != 0).cast("bigint") * copies)
    total = F.sum(copies) - (positives if ratio_basis == "negatives" else F.lit(0))
    # Null, and not 1, when there is nothing to repeat.
    ratio = F.when(positives > 0, F.greatest(F.ceil(total / positives), F.lit(1)))
    times = df.agg(ratio.cast("int").alias("ratio")).scalar()
    return F.coalesce(
        times, F.raise_error(F.lit("no positive examples, refusing to balance")).cast("int")
    )


def balance_classes(df: DataFrame, ratio_basis: str = "total") -> DataFrame:
    """Repeat every positive ceil(total / positives) times.

    ``ratio_basis="negatives"`` uses ceil(negatives / positives) instead, which
    is what evens out the classes.  Without any positive the result raises.
    """
    times = _times(df, ratio_basis)
    copies = F.array_repeat(F.lit(1), F.when(F.col("label") != 0, times).otherwise(F.when(times > 0, 1)))
    return df.withColumn("copy", F.explode(copies)).drop("copy")


def weigh_classes(df: DataFrame, ratio_basis: str = "total") -> DataFrame:
    """Add ``weight``: how often :func:`balance_classes` would repeat the row and its ``copies``, without a copy of it."""
    times = _times(df, ratio_basis)
    weight = F.when(F.col("label") != 0, times).otherwise(F.when(times > 0, 1))
    return df.withColumn("weight", (weight * _copies(df)).cast("double"))
