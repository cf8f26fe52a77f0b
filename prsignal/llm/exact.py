"""Exact de-duplication by recipes of content-defined chunks, in DataFrame expressions only.

A text is cut into chunks where its own content says so: at the first sentence
or line end after ``MIN_CHUNK`` characters, at the latest after ``MAX_CHUNK``.
An inserted passage therefore changes only the chunks around it.  Chunks are
de-duplicated, each distinct one moving once per task, and get an identifier:
their 64-bit hash, and a number that tells apart different chunks of one hash.
The number is found by comparing the chunks themselves, so identifiers are equal
exactly when the chunks are.  Texts are equal exactly when their lists of
identifiers are, and only these short lists are grouped, joined and moved.

Defined results: null counts as empty, and all empty texts are equal; of equal
texts the row with the largest id stays (nulls last; of rows that also share the
id, one); repeated rows are copies of each other; a text of any length is read
whole; other columns are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prsignal.llm.common import kept, whole_text

MIN_CHUNK, MAX_CHUNK = 384, 4096

# To the first sentence or line end after MIN_CHUNK characters; without one, MAX_CHUNK or what is left.
_CHUNK = rf"(?s).{{{MIN_CHUNK - 1},{MAX_CHUNK - 1}}}?[.!?\n]|.{{1,{MAX_CHUNK}}}"

# Collided chunks that are broadcast; more of them are joined by a shuffle.
BROADCAST_CHUNKS = 1000

Hash = Callable[[Column], Column]


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def collided(texts: DataFrame, hash_of: Hash = F.xxhash64) -> DataFrame | None:
    """(hash, chunk, number): distinct chunks whose hash a smaller chunk has too, numbered from 1.

    None when there are none, which the distinct chunks of all texts have to show.
    """
    distinct = (
        texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
        .groupBy(hash_of(F.col("chunk")).alias("hash"), "chunk")
        .agg(F.lit(1).alias("one"))
    )
    several = kept(distinct.groupBy("hash").agg(F.sum("one").alias("n")).where("n > 1").select("hash"))
    if several.isEmpty():
        return None
    number = F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1
    return kept(
        distinct.join(several, "hash", "left_semi")
        .select("hash", "chunk", number.alias("number"))
        .where("number > 0")
    )


def recipes(texts: DataFrame, hash_of: Hash = F.xxhash64) -> DataFrame:
    """``texts`` (row, text, ...) with ``recipe``, the list of chunk identifiers, in place of the text."""
    others = [c for c in texts.columns if c != "text"]
    found = collided(texts, hash_of)
    if found is None:
        recipe = F.transform(chunks(F.col("text")), lambda c: hash_of(c))
        return texts.select(*others, recipe.alias("recipe"))
    if found.count() <= BROADCAST_CHUNKS:
        found = F.broadcast(found)
    part = F.struct("pos", "hash", F.coalesce("number", F.lit(0)).alias("number"))
    lists = (
        texts.select("row", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
        .withColumn("hash", hash_of(F.col("chunk")))
        .join(found, ["hash", "chunk"], "left")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select(
            "row",
            F.flatten(F.transform("parts", lambda p: F.array(p["hash"], p["number"].cast("long")))).alias("recipe"),
        )
    )
    empty = F.array().cast("array<bigint>")
    return texts.select(others).join(lists, "row", "left").withColumn("recipe", F.coalesce("recipe", empty))


def copies(docs: DataFrame, id_col="doc_id", text_col="text", hash_of: Hash = F.xxhash64) -> DataFrame:
    """(row, id, keep_id, group_size, kept, text_sha256): one row per document.

    ``row`` is a number of the row in this result only.
    """
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    texts = texts.withColumn("text_sha256", F.sha2("text", 256))
    if hash_of is F.xxhash64:
        numbered = texts.withColumn("row", F.monotonically_increasing_id())
    else:
        numbered = kept(texts.withColumn("row", F.monotonically_increasing_id()))
    listed = kept(recipes(numbered, hash_of))
    groups = listed.groupBy("recipe").agg(
        F.max(F.struct(F.col("id").isNotNull(), "id", "row")).alias("keep"),
        F.count(F.lit(1)).alias("group_size"),
    )
    return listed.join(groups, "recipe").select(
        "row",
        F.col("id").alias(id_col),
        F.col("keep")["id"].alias("keep_id"),
        "group_size",
        (F.col("keep")["row"] == F.col("row")).alias("kept"),
        "text_sha256",
    )
