"""Which queries of the training-data package are registered, and which of them have SQL."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from prsignal.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered_and_says_whether_it_has_sql():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert queries.ORACLE_SQL.keys() == {
        "op3_url_rules", "op9_exact_copies", "op11_collocations", "op12_conversations",
    }
    assert entry.LLM_QUERIES.keys() == {*queries.QUERIES, "pipeline"}
    assert entry.LLM_SQL.keys() == queries.ORACLE_SQL.keys()


def test_packing_as_a_stage(spark):
    """All that the stage before has kept is packed, with clashing names, nulls and repeated rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(7, None, "en", "s", 0), (7, "", None, None, None), (None, "a b", "en", "s", 3)], docs.schema)
    docs = docs.unionByName(odd).unionByName(odd).withColumn("piece", F.lit("x")).withColumn("item", F.lit(1))
    got = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[r.doc_id, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
