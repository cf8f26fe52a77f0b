"""SimHash fingerprints of documents and a search by permuted block tables.

Terms are the runs of five lower-cased words of a text (all words, if it has
fewer).  Each term votes with 1 + log2(its count) for or against each of 64 bits,
by the bits of its hash; a fingerprint has the bits with a positive sum.

``within`` finds all fingerprints within a Hamming radius r.  The 64 bits are
cut into b > r blocks; two fingerprints that differ in at most r bits agree in
at least b - r blocks whole, so each choice of b - r blocks is a table whose key
is these blocks, moved to the front.  Candidates meet by equality of a key and
are confirmed by the distance, so nothing is missed.  ``neighbours`` counts what
it finds for a stated set of rows against all.

Defined results: null counts as empty; a text without words has the fingerprint
0; equal texts have equal fingerprints.  The next document of an id is the one
with the least greater id (of several with that id, the least text), after the
last id the first; null ids come before all others.  Every row, repeated ones
too, has its own result; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prsignal.llm.common import caches, whole_text

WORDS, BITS = 5, 64

# Words whose hash a Python worker remembers, and terms that are summed at a time.
REMEMBERED, BLOCK = 500_000, 1 << 16

# Id ranges for each shuffle partition.
RANGES = 4

_NO_ID = -(1 << 63)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode())
        return value


_hash_of = _WordHashes()
caches.append(_hash_of.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def terms(text: str) -> np.ndarray:
    """The 64-bit hashes of the runs of words, in order."""
    words = text.lower().split()
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return mixed(out)


def fingerprint(text: str) -> int:
    hashes, counts = np.unique(terms(text), return_counts=True)
    if not len(hashes):
        return 0
    weights = 1 + np.log2(counts)
    votes = np.full(BITS, -weights.sum() / 2)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[at : at + BLOCK].astype(np.float32) @ bits.astype(np.float32)
    return int(np.packbits(votes > 1e-3, bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ranges(docs: DataFrame) -> tuple[list[int], list[tuple[int, int]]]:
    """Bounds of id ranges, and (range, its first id) of the ranges that have rows, ascending.

    Both are as long as there are ranges, whatever the data.
    """
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    cut = docs.agg(F.percentile_approx("id", shares, 10 * n)).first()[0]
    bounds = sorted(set(cut or []))
    if not bounds:
        first = docs.agg(F.min("id")).first()[0]
        return [], [] if first is None else [(0, first)]
    firsts = (
        docs.mapInArrow(
            lambda batches: (
                pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.searchsorted(bounds, b.column(0).to_numpy(), "right").astype(np.int32)),
                        b.column(0),
                    ],
                    ["range", "id"],
                )
                for b in batches
            ),
            "range int, id long",
        )
        .groupBy("range")
        .agg(F.min("id").alias("id"))
        .collect()
    )
    return bounds, sorted((r["range"], r["id"]) for r in firsts)


def edited_fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Fingerprints of every text, its edited text, and how like they are.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next).  Texts move once, to ranges of ids; the first documents of a
    range also go to the range before it, so that each document meets its next.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), whole_text(text_col).alias("text")
    )
    bounds, firsts = _ranges(rows.select("id"))
    # Whose texts close which range; the last range is closed by the first text of all.
    closes = {first: previous for (previous, _), (_, first) in zip(firsts, firsts[1:] + firsts[:1])}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array(sorted(closes), np.int64)
        names = ["range", "closing", "id", "text"]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            ranges = np.searchsorted(bounds, ids, "right").astype(np.int32) if bounds else np.zeros(len(ids), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges), pa.array(np.zeros(len(ids), bool)), batch.column(0), batch.column(1)], names
            )
            copied = np.flatnonzero(np.isin(ids, starts))
            if len(copied):
                again = batch.take(pa.array(copied))
                ranges = pa.array([closes[i] for i in ids[copied].tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ranges, pa.array(np.ones(len(copied), bool)), again.column(0), again.column(1)], names
                )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []  # the range and id that the waiting rows share
        for batch in batches:
            out: list[tuple] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for i, (place, closing, doc) in enumerate(keys):
                if closing and not waiting:
                    continue
                text = batch.column(3)[i].as_py()
                own = fingerprint(text)
                if waiting and (closing or at != (place, doc)):
                    for wid, wtext, wown in waiting:
                        changed = edited(wtext, text)
                        new = fingerprint(changed)
                        out.append(
                            (
                                None if wid == _NO_ID else wid,
                                len(wtext),
                                hashlib.sha256(changed.encode()).hexdigest(),
                                f"{wown:016x}",
                                f"{new:016x}",
                                likeness(wown, new),
                                likeness(wown, own),
                            )
                        )
                    waiting = []
                if not closing:
                    waiting.append((doc, text, own))
                    at = (place, doc)
            columns = list(zip(*out)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)

    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.mapInArrow(placed, "range int, closing boolean, id long, text string")
        .repartition(spread, "range")
        .sortWithinPartitions("range", "closing", "id", "text")
        .mapInArrow(
            compared,
            "id long, n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double",
        )
        .withColumn("id", F.col("id").cast(id_type))
        .withColumnRenamed("id", id_col)
    )


_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _as_long(fp: Column) -> Column:
    """The 64 bits of a hexadecimal fingerprint as a signed long."""
    high, low = (F.conv(F.substring(fp, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, found, distance): all stored fingerprints within the radius of each queried one.

    Both inputs have a column ``fingerprint``; equal ones count once, so a group
    of copies is one entry.  The queries are a stated set, not all rows.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("there must be more blocks than the radius")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        value = df.select("fingerprint").where("fingerprint IS NOT NULL").distinct()
        value = value.select(F.col("fingerprint").alias(name), _as_long(F.col("fingerprint")).alias(f"{name}_bits"))
        tables = []
        for k, chosen in enumerate(itertools.combinations(masks, blocks - radius)):
            mask = sum(chosen)
            mask -= (mask >> 63) << 64  # as a signed long
            tables.append(F.struct(F.lit(k).alias("k"), F.col(f"{name}_bits").bitwiseAND(F.lit(mask)).alias("key")))
        return value.select(name, f"{name}_bits", F.inline(F.array(*tables)))

    distance = F.bit_count(F.col("query_bits").bitwiseXOR(F.col("found_bits")))
    return (
        keyed(queries, "query")
        .join(keyed(fingerprints, "found"), ["k", "key"])
        .select("query", "found", distance.cast("int").alias("distance"))
        .where(F.col("distance") <= radius)
        .distinct()
    )


def neighbours(
    fingerprints: DataFrame, asked: Column, radius: int = 3, blocks: int = 6
) -> DataFrame:
    """``fingerprints`` with ``n_within`` and ``least_distance`` for the rows that ``asked`` chooses (null for others).

    ``n_within`` is the number of other fingerprints in the whole table that
    differ in at most ``radius`` bits (copies have one fingerprint, which counts
    once and not for itself), ``least_distance`` the fewest bits (null if none).
    """
    found = (
        within(fingerprints.where(asked), fingerprints, radius, blocks)
        .where("found != query")
        .groupBy(F.col("query").alias("fingerprint"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("least_distance"))
    )
    n_within = F.when(asked, F.coalesce("n", F.lit(0)))
    return fingerprints.join(found, "fingerprint", "left").select(
        *fingerprints.columns, n_within.alias("n_within"), F.when(asked, F.col("least_distance")).alias("least_distance")
    )
