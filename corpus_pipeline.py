"""A corpus pipeline: stages over documents, each written as Parquet and read again by the next.

language   documents whose language is not known well enough go
exact      of equal texts one stays
near       of each group of similar texts (five words, similarity 0.8) one stays
passages   repeated passages go, but for their first occurrence
packing    what is left is packed into sequences of tokens

Defined results: null text counts as empty; a text that is null or has no letter
has no language, so its row goes in the first stage; a null id is an id like
others.  Of rows that also share the id, one stays where one of a group stays,
and of tied rows any, as they are alike.  Texts of any length are read whole.
Extra columns are carried along by all stages but the last and never looked at,
whatever their names.  An empty table stays empty, and so does what is left when
a stage keeps nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.llm import exact, jaccard, langid, suffixes
from prsignal.llm import packing as packs
from prsignal.llm.common import bounded_batches, only, release, shared_folder, tie_of, whole_text, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Stands for a null id in joins.
_NO_ID = -(1 << 63)

_tables_of_last_stage: list[str] = []


def stage(function: Stage) -> Stage:
    """A stage that first removes the intermediate tables of the one before, whose result is written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _tables_of_last_stage)
        bounded_batches(spark)
        before = set(written())
        out = function(spark, docs, sf_dir)
        _tables_of_last_stage[:] = [path for path in written() if path not in before]
        return out

    return run


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


@stage
def language(spark, docs, sf_dir):
    held_out = langid.remainder(F.col("doc_id"), 4) == 2
    return langid.accepted(docs, langid.fit(docs, held_out=held_out))


@stage
def exact_copies(spark, docs, sf_dir):
    found = exact.copies(docs).select(_id().alias("_id"), F.col("text_sha256").alias("_sha256"), "kept")
    return only(docs, found, {"_id": _id(), "_sha256": F.sha2(whole_text(), 256)})


@stage
def near_copies(spark, docs, sf_dir):
    found = jaccard.similar(docs).select(_id().alias("_id"), F.col("tie").alias("_tie"), "kept")
    return only(docs, found, {"_id": _id(), "_tie": tie_of(whole_text())})


@stage
def passages(spark, docs, sf_dir):
    left = suffixes.without_repeats(docs, whole_characters=True)
    text = F.col("left").cast("string")
    columns = {c: F.col("rest")[c] for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns[c].alias(c) for c in docs.columns])


@stage
def packing(spark, docs, sf_dir):
    return packs.packed(docs, Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes())


STAGES = [
    ("language", language),
    ("exact", exact_copies),
    ("near", near_copies),
    ("passages", passages),
    ("packing", packing),
]

# Stages that learn, evolve and hash in their own way can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        out = function(spark, docs, sf_dir)
        before, path = path, f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            release(spark, [before])
    return docs
