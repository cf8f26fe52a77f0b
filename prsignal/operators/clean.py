"""Cleaning of raw review-comment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prsignal.functions.text import decode_json_text, parse_int, strip_quotes


def known_pull_requests(df: DataFrame) -> DataFrame:
    """Drop rows whose pull request url is null or the text "null"."""
    return df.dropna("any", subset=["pull_request_url"]).where(F.col("pull_request_url") != "null")


def clean_positions(positions: Column) -> Column:
    """Maps of text to structs of int; anything that is not an int is null."""
    return F.transform(
        positions,
        lambda p: F.struct(
            parse_int(F.try_element_at(p, F.lit("original_position"))).alias("original_position"),
            parse_int(F.try_element_at(p, F.lit("new_position"))).alias("new_position"),
        ),
    )


def clean_comments(raw: DataFrame) -> DataFrame:
    """Raw rows to cleaned rows: quotes gone, hunks decoded, positions as ints."""
    return known_pull_requests(raw).select(
        strip_quotes(F.col("pull_request_url")).alias("pull_request_url"),
        strip_quotes(F.col("pull_patch_url")).alias("pull_patch_url"),
        clean_positions(F.col("comment_positions")).alias("comment_positions"),
        "comment_text",
        F.transform("diff_hunks", decode_json_text).alias("diff_hunks"),
        F.transform("comment_file_paths", strip_quotes).alias("comment_file_paths"),
        F.transform("comment_commit_ids", strip_quotes).alias("comment_commit_ids"),
    )
