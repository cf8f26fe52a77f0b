"""Scalar text functions, all as JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File formats that count as source code, as listed (they are
# compared in lower case, and ".ipynb" is listed with its dot).
FILE_FORMATS = (
    "md", "scala", "go", "gs", "html", "AHK", "APPLESCRIPT", "AS", "AU3", "BAT", "BAS", "CLJS",
    "CMD", "Coffee", "CPP", "duino", "EGG", "EGT", "ERB", "HTA", "IBI", "ICI", "IJS", ".ipynb",
    "ITCL", "JS", "JSFL", "LUA", "M", "MRC", "PHP", "PHP5", "PHP6", "PHP7", "PL", "PM", "PY",
    "R", "RB", "RUBY", "TCL", "VBS",
)

# Patterns.
EXTENSION = r"\A.+[a-zA-Z0-9]+\.([a-zA-Z\+]*?)\z"
STACK_FRAME = r"[\s\\/]+([^ /]*?\.(scala|java|go|cpp|py|pyc)):(\d+)\s*"
END_QUOTES = r'^"|"$'
END_QUOTE_RUNS = r'^"+|"+$'
DIRECTORIES = r".*/"
WHITESPACE_ONLY = r"\A\s+\z"
# One JSON string literal and nothing else; possessive, so that long texts need no stack.
JSON_TEXT = r'(?s)\A\s*+"(?:[^"\\]++|\\.)*+"\s*+\z'
# The training side once wrote this pattern with a lost backslash.
WHITESPACE_ONLY_COMPAT = r"^s+$"


def strip_quotes(text: Column) -> Column:
    """Remove one double quote at each end."""
    return F.regexp_replace(text, END_QUOTES, "")


def strip_quote_runs(text: Column) -> Column:
    """Remove all double quotes at each end."""
    return F.regexp_replace(text, END_QUOTE_RUNS, "")


def drop_quotes(text: Column) -> Column:
    """Remove every double quote."""
    return F.replace(text, F.lit('"'), F.lit(""))


def decode_json_text(text: Column) -> Column:
    """Decode a JSON string literal; text that is anything else gives null."""
    decoded = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(text.rlike(JSON_TEXT), decoded)


def parse_int(text: Column) -> Column:
    """Signed decimal digits to int, else null.  Blanks are not trimmed."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int"))


def basename(path: Column) -> Column:
    return F.regexp_replace(path, DIRECTORIES, "")


def extension(path: Column) -> Column:
    """Extension in lower case when it is a listed format, else null."""
    found = F.regexp_extract(F.lower(path), EXTENSION, 1)
    return F.when(found.isin([f.lower() for f in FILE_FORMATS]), found)


def only_spaces(text: Column, compat: bool = False) -> Column:
    return text.rlike(WHITESPACE_ONLY_COMPAT if compat else WHITESPACE_ONLY)


def diff_url(patch_url: Column) -> Column:
    """``….patch`` to ``….diff``: cut five characters, add ``diff``."""
    return F.concat(F.substring(patch_url, F.lit(1), F.length(patch_url) - 5), F.lit("diff"))


def project_of(pull_request_url: Column) -> Column:
    """``owner/name`` of an API url ``…/repos/owner/name/pulls/n``, else null."""
    return F.nullif(
        F.regexp_extract(pull_request_url, r"/repos/([^/]+/[^/]+)/pulls/", 1), F.lit("")
    )


def stack_frames(text: Column) -> Column:
    """``array<struct<filename, line>>`` of the stack frames in a text, in order.

    Parentheses count as blanks.  A frame whose line number does not fit an int
    has a null line.
    """
    plain = F.translate(text, "()", "  ")
    # The text is searched once; a match on its own matches the same way again.
    return F.transform(
        F.regexp_extract_all(plain, F.lit(STACK_FRAME), F.lit(0)),
        lambda frame: F.struct(
            F.regexp_extract(frame, STACK_FRAME, 1).alias("filename"),
            F.regexp_extract(frame, STACK_FRAME, 3).try_cast("int").alias("line"),
        ),
    )


def bucket_of(key: Column, buckets: int | Column) -> Column:
    """Layout-independent bucket of a key: the first 32 bits of its md5, modulo ``buckets``."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets
