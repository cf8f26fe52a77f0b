"""Every stage of the pipeline on its own input, and the whole."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prsignal.llm import common
from test_operators import linked_components, without_repeats

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_language_keeps_what_is_sure(spark, docs):
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 !", "en", "s", 5)], docs.schema)
    kept = STAGES["language"](spark, docs.unionByName(odd), SF)
    assert kept.schema == docs.schema and kept.where("doc_id >= 1000000").count() == 0
    assert kept.count() >= 0.98 * docs.count()


def test_exact_copies_leave_one(spark, docs):
    kept = STAGES["exact"](spark, docs.unionByName(docs.limit(20)), SF)
    want = docs.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.max("doc_id").alias("doc_id"))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in want.collect())


def test_rows_are_kept_alike_with_and_without_broadcast(spark, docs):
    some = docs.limit(40)
    found = some.unionByName(some).select(F.col("doc_id").alias("_id"), (F.col("doc_id") % 3 == 0).alias("kept"))
    for most in (0, 1000):
        got = common.only(some.unionByName(some), found, {"_id": F.col("doc_id")}, most)
        assert sorted(r.doc_id for r in got.collect()) == sorted(r._id for r in found.where("kept").collect())


def test_near_copies_leave_the_first(spark, docs):
    kept = STAGES["near"](spark, docs, SF)
    of = linked_components(pairs(docs), 5, 80, 100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in of.values()})


def test_passages_are_removed(spark, docs):
    kept = STAGES["passages"](spark, docs, SF)
    assert kept.schema == docs.schema and kept.where(F.length("text") != F.col("n_chars")).count() == 0
    left = without_repeats(pairs(docs), 100)
    for r in kept.collect():
        assert 0 <= len(r.text.encode()) - len(left[r.doc_id][1]) <= 200 and r.text.encode() != b"\xff"


def test_run_writes_every_stage_and_empty_tables_pass(spark, docs, tmp_path):
    got = corpus_pipeline.run(spark, SF)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert 0 < got.select("doc_id").distinct().count() <= docs.count()
    df = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        out.write.parquet(str(tmp_path / name))
        df = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        assert df.count() == 0
    corpus_pipeline.release(spark, common.written())
    assert common.written() == []
