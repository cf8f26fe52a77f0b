"""Small session helpers."""

from __future__ import annotations

import contextvars
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Shuffle files go at the end of a query; without it, when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session that is all on one machine uses a folder in
    its warehouse; on a cluster, whose default warehouse may be local to each
    machine, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder, and read from there.

    Lost executors cost no rerun of what came before, several readers share the
    work, and the size of the table is known to the joins that follow.  Within
    :func:`scratch` the table goes when the work is done; else it stays, as a
    lazy result may still read it.  What was shuffled for it goes at once, and
    the table itself is packed closely, as several are on disk together.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    tables = _scratch.get()
    if tables is not None:
        tables.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are materialized inside, also when it fails.

    For work whose results are written before it ends; nothing read later may
    depend on these tables.
    """
    tables: list[str] = []
    token = _scratch.set(tables)
    try:
        yield
    finally:
        _scratch.reset(token)
        path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        for path in tables:
            target = path_of(path)
            target.getFileSystem(conf).delete(target, True)


def materialize_last(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """:func:`materialize` what ``make`` gives, and remove the tables that were materialized on the way to it."""
    outside = contextvars.copy_context()
    with scratch(spark):
        return outside.run(materialize, make())
