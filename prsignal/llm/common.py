"""What the operators of this package share: reading, intermediate tables, batches of texts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prsignal.session import checkpoint_dir

# Rows that Python code turns into one output batch; bounds the memory of a task.
SLICE = 512

_written: list[str] = []


# Rows that go to Python at once.  Spark's own 10,000 would be a batch of more than 100 MB where texts are long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand whole texts to Python in small batches, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def tie_of(text: Column) -> Column:
    """128 bits of the text's SHA-256 in hex, which tell rows of one id apart."""
    return F.substring(F.sha2(text, 256), 1, 32)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse, on one machine only."""
    return checkpoint_dir(spark)


def kept(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it from there.

    What follows survives lost executors without a rerun, and several readers
    share one computation.  ``release`` removes the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The paths of the tables kept so far."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove kept tables; nothing that is still to be computed may read them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _written:
            _written.remove(name)


def map_slices(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema,
    rows: int = SLICE,
) -> DataFrame:
    """``mapInArrow`` over small slices, so that a task holds the output of few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield function(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


# What clears the caches that modules of this worker keep from task to task.
caches: list[Callable[[], None]] = []


def give_back() -> None:
    """Return the memory that a Python worker holds, caches of other operators too, at the end of a task.

    Workers are used again by later stages, which have no use for these caches.
    """
    for clear in caches:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


# Keys that are broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 500_000


def only(docs: DataFrame, found: DataFrame, keys: dict[str, Column], most: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``docs`` that are kept: for each key, as many rows as ``found`` says.

    ``found`` has the key columns and ``kept`` for every row of ``docs``; ``keys``
    says how the key columns follow from ``docs``.  Rows of one key are alike but
    for columns that don't count.  Texts move only for keys that lose rows, as
    long as these keys are few enough to be broadcast, which is counted.
    """
    names = list(keys)
    surplus = kept(
        found.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col("kept").cast("int")).alias("_wanted"))
        .where("_all > _wanted")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, *[c.alias(k) for k, c in keys.items()])
    number = F.row_number().over(Window.partitionBy(*names).orderBy(names[0]))
    if surplus.count() > most:
        joined = rows.join(surplus, names, "left").withColumn("_number", number)
        return joined.where("_wanted IS NULL OR _number <= _wanted").select("_row.*")
    surplus = F.broadcast(surplus)
    some = rows.join(surplus.where("_wanted > 0"), names).withColumn("_number", number).where("_number <= _wanted")
    return rows.join(surplus, names, "left_anti").select("_row").unionByName(some.select("_row")).select("_row.*")
