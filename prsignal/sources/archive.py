"""Reading the event archive by day."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.schemas import ARCHIVE_EVENT


def resolve_date(token: str, as_of: dt.date | None = None) -> str:
    """``yesterday`` or ``today`` relative to ``as_of`` as yyyymmdd; other text as it is."""
    as_of = as_of or dt.date.today()
    if token == "yesterday":
        return f"{as_of - dt.timedelta(days=1):%Y%m%d}"
    if token == "today":
        return f"{as_of:%Y%m%d}"
    return token


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive as Parquet, partitioned by ``day``."""
    return spark.read.schema(ARCHIVE_EVENT).parquet(path)


def scan_days(archive: DataFrame, prefix: str, day_col: str = "day") -> DataFrame:
    """All day shards whose yyyymmdd name starts with ``prefix`` (``2018`` is the year).

    On a table partitioned by day this prunes partitions.
    """
    return archive.where(F.col(day_col).startswith(prefix))


def _bounds(prefix: str) -> tuple[dt.datetime, dt.datetime] | None:
    """The time range of a yyyy, yyyymm or yyyymmdd prefix."""
    if not prefix.isdigit() or len(prefix) not in (4, 6, 8):
        return None
    year, month, day = int(prefix[:4]), int(prefix[4:6] or 1), int(prefix[6:8] or 1)
    first = dt.datetime(year, month, day)
    days = {
        4: 366 if calendar.isleap(year) else 365,
        6: calendar.monthrange(year, month)[1],
        8: 1,
    }[len(prefix)]
    return first, first + dt.timedelta(days=days)


def scan_days_by_time(events: DataFrame, prefix: str, ts_col: str = "ts") -> DataFrame:
    """As :func:`scan_days` for a table that has a timestamp and no day column.

    A whole year, month or day becomes a time range, which reaches the Parquet
    reader as a pushed filter; other prefixes compare the formatted day.
    """
    bounds = _bounds(prefix)
    ts = F.col(ts_col)
    if bounds is None:
        return events.where(F.date_format(ts, "yyyyMMdd").startswith(prefix))
    kind = events.schema[ts_col].dataType.simpleString()
    low, high = (F.lit(b.isoformat(" ")).cast(kind) for b in bounds)
    return events.where((ts >= low) & (ts < high))


def missing_days(requested: DataFrame, present: DataFrame, day_col: str = "day") -> DataFrame:
    """Requested days that are not present yet."""
    return (
        requested.select(day_col)
        .distinct()
        .join(present.select(day_col).distinct(), day_col, "left_anti")
    )
