"""Packing documents into as few token sequences as possible, by a grouping genetic algorithm.

A document is its token ids and the id 0; only longer ones are cut, into pieces
of the capacity.  Full pieces are sequences of their own.  The others are dealt
by hash to shards of about ``SHARD`` pieces, and for each shard several islands
evolve packings, each island in a task of its own.  A packing is a list of
groups (the lengths in one sequence).  Crossover injects whole well-filled
groups of one parent into the other, takes the duplicates of their lengths out,
and best-fits the displaced ones, longest first.  After a round every island
gets the best packing of its neighbour, and evolves again; the best of all
islands is the packing of the shard.  A shard is done as soon as it needs no more
sequences than its tokens fill.

A task holds the lengths of one shard, never more; the tokens themselves are
counted and checksummed where the text is read and are not moved.

Ids are those of the library with its defaults, but for special tokens around a
text: the words ``<|endoftext|>`` and ``<|startoftext|>`` in a document are the
ids of these markers.

Defined results: null counts as empty, so that a document without tokens is one
piece of length 1; texts of any length are tokenised whole; repeated rows are
pieces of their own; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import functools
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prsignal.llm.common import caches, kept, map_slices, type_of, whole_text

CAPACITY, END = 2048, 0
SHARD, ISLANDS, ROUNDS = 32_768, 3, 2
POPULATION, GENERATIONS, INJECTED = 5, 6, 0.1

# Words whose ids a Python worker remembers.
REMEMBERED = 800_000

Packing = list[list[int]]


# A word of letters that no normalisation joins or splits, and the marks that may follow it as one more pre-token.
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([{_MARKS}]*)")


class Tokens:
    """Ids of texts.  White space separates words in this vocabulary, and each distinct word is encoded once.

    Words of plain letters are one pre-token each, whose last id carries the word
    end, so many of them are encoded in one call and their ids told apart.  They
    need only be lower-cased and cut at white space, so the same vocabulary does
    that for them without the general normalisation and pattern.  A text in which
    a marker may stand is encoded as a whole.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(data.decode())
        self._tokenizer.encode_special_tokens = True
        cut = [{"type": "WhitespaceSplit"}, json.loads(data)["pre_tokenizer"]["pretokenizers"][1]]
        plain = json.loads(data) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": cut}}
        self._plain = Tokenizer.from_str(json.dumps(plain))
        self._plain.encode_special_tokens = True
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._seen: dict[str, bytes] = {"": b""}

    def _learn(self, words: list[str]) -> None:
        seen = self._seen
        alike = [m for w in words if (m := _PLAIN.fullmatch(w))]
        if alike:
            parts = [m.groups() for m in alike]
            text = " ".join([f"{core} {marks}" if marks else core for core, marks in parts]).lower()
            ids = np.array(self._plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            packed = ids.tobytes()
            # Each word has one word end, or two with the one of its marks.
            last = np.cumsum([1 + bool(marks) for _, marks in parts]) - 1
            ends = (4 * (np.flatnonzero(self._ends[ids])[last] + 1)).tolist()
            seen.update(zip([m.string for m in alike], [packed[a:b] for a, b in zip([0, *ends], ends)]))
        others = [w for w in words if w not in seen] if len(alike) < len(words) else []
        for word, e in zip(others, self._tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            seen[word] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        if len(self._seen) > REMEMBERED:
            self._seen = {"": b""}
        known = self._seen.get
        marked = {i: self._whole(text) for i, text in enumerate(texts) if "<|" in text}
        lists = [[""] if i in marked else text.replace("\n", " ").split(" ") for i, text in enumerate(texts)]
        found = [list(map(known, words)) for words in lists]
        self._learn(list({w for words, got in zip(lists, found) if None in got for w, g in zip(words, got) if g is None}))
        out = [
            b"".join([known(w) if g is None else g for w, g in zip(words, got)] if None in got else got)
            for words, got in zip(lists, found)
        ]
        for i, ids in marked.items():
            out[i] = ids
        return out

    def _whole(self, text: str) -> bytes:
        """Ids of a text with its markers."""
        self._tokenizer.encode_special_tokens = False
        try:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        finally:
            self._tokenizer.encode_special_tokens = True


@functools.lru_cache(maxsize=2)
def _tokens(data: bytes) -> Tokens:
    return Tokens(data)


caches.append(_tokens.cache_clear)


def pieces(docs: DataFrame, tokenizer: bytes, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """(item, id, piece, start, length, ids_crc32): the pieces of every whole text.

    ``tokenizer`` is the content of a tokenizer file, of fixed size whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = _tokens(shared.value)
        end = np.array([END], "<u4").tobytes()
        totals, sums = [], []
        for ids in t.ids(batch.column(1).to_pylist()):
            ids += end
            totals.append(len(ids) // 4)
            sums.append([zlib.crc32(ids[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(totals, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["id", "n", "sums"]
        )

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    counted = map_slices(rows, run, f"id {type_of(rows, 'id')}, n long, sums array<long>")
    start = F.col("piece").cast("long") * capacity
    return counted.select("id", "n", F.posexplode("sums").alias("piece", "ids_crc32")).select(
        F.monotonically_increasing_id().alias("item"),
        F.col("id").alias(id_col),
        "piece",
        start.alias("start"),
        F.least(F.lit(capacity), F.col("n") - start).alias("length"),
        "ids_crc32",
    )


def best_fit(lengths: list[int], capacity: int, groups: Packing | None = None) -> Packing:
    """Put each length, in the given order, into the fullest group that has room for it."""
    groups = groups or []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some group has room r
    for g, group in enumerate(groups):
        room = capacity - sum(group)
        by_room.setdefault(room, []).append(g)
        rooms |= 1 << room
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            g = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            groups[g].append(n)
        else:
            room, g = capacity, len(groups)
            groups.append([n])
        by_room.setdefault(room - n, []).append(g)
        rooms |= 1 << (room - n)
    return groups


def fitness(groups: Packing, capacity: int) -> tuple[int, float]:
    """Fewer groups are better, then fuller ones; larger is fitter."""
    return -len(groups), sum((sum(g) / capacity) ** 2 for g in groups)


def crossover(base: Packing, donor: Packing, capacity: int, rng: random.Random) -> Packing:
    """Well-filled groups of the donor, then what is left of the base, then the displaced lengths."""
    ranked = sorted(donor, key=lambda g: (-sum(g), rng.random()))
    top = ranked[: max(1, int(len(ranked) * INJECTED * 3))]
    chosen = [list(g) for g in rng.sample(top, max(1, len(top) // 3))]
    duplicates = Counter(n for g in chosen for n in g)
    child, displaced = chosen, []
    for group in sorted(base, key=lambda g: (sum(g), rng.random())):
        if any(duplicates[n] for n in group):
            for n in group:
                if duplicates[n]:
                    duplicates[n] -= 1
                else:
                    displaced.append(n)
        else:
            child.append(list(group))
    displaced.sort(reverse=True)
    return best_fit(displaced, capacity, child)


def evolve(lengths: list[int], capacity: int, seed: int, migrants: list[Packing] = ()) -> Packing:
    """The best packing that an island finds; ``lengths`` are descending."""
    rng = random.Random(seed)
    enough = math.ceil(sum(lengths) / capacity)
    population = [list(map(list, m)) for m in migrants]
    population.append(best_fit(lengths, capacity))
    while len(population) < POPULATION and min(map(len, population)) > enough:
        # Nearly descending, each island in its own way.
        order = sorted(lengths, key=lambda n: -n * rng.uniform(0.9, 1))
        population.append(best_fit(order, capacity))
    for _ in range(GENERATIONS):
        population.sort(key=lambda p: fitness(p, capacity), reverse=True)
        if len(population[0]) <= enough or len(population) < 2:
            break
        best, other = population[0], rng.choice(population[1:])
        for a, b in ((best, other), (other, best)):
            population.append(crossover(a, b, capacity, rng))
        population = sorted(population, key=lambda p: fitness(p, capacity), reverse=True)[:POPULATION]
    return max(population, key=lambda p: fitness(p, capacity))


def as_numbers(groups: Packing, lengths: list[int]) -> np.ndarray:
    """The group of each length; equal lengths are given out in order."""
    places: dict[int, list[int]] = {}
    for g, group in enumerate(groups):
        for n in group:
            places.setdefault(n, []).append(g)
    taken: Counter = Counter()
    out = np.empty(len(lengths), np.int32)
    for i, n in enumerate(lengths):
        out[i] = places[n][taken[n]]
        taken[n] += 1
    return out


def as_groups(numbers: np.ndarray, lengths: list[int]) -> Packing:
    groups: Packing = [[] for _ in range(int(numbers.max()) + 1 if len(numbers) else 0)]
    for g, n in zip(numbers.tolist(), lengths):
        groups[g].append(n)
    return groups


_ISLAND = "shard long, island int, lengths array<int>, groups binary, n_groups int, fullness double"


def _evolved(islands: DataFrame, capacity: int, turn: int) -> DataFrame:
    """One round on every island: (shard, island, lengths[, groups, migrant]) to the best packing it knows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row in batch.to_pylist():
            lengths = row["lengths"]
            known = [
                as_groups(np.frombuffer(row[name], np.int32), lengths)
                for name in ("groups", "migrant")
                if row.get(name) is not None
            ]
            seed = (row["shard"] * ISLANDS + row["island"]) * ROUNDS + turn
            best = evolve(lengths, capacity, seed, known)
            size, fullness = fitness(best, capacity)
            out.append((row["shard"], row["island"], lengths, as_numbers(best, lengths).tobytes(), -size, fullness))
        types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.float64())
        names = ["shard", "island", "lengths", "groups", "n_groups", "fullness"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return map_slices(islands, run, _ISLAND, rows=1)


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``items`` (item, length, ...) with ``sequence_id`` and ``offset``.

    ``item`` numbers the rows; the table has to be one that can be read again
    with the same numbers.
    """
    full = items.where(F.col("length") >= capacity)
    full = full.withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    small = items.where(F.col("length") < capacity)
    n_shards = max(1, math.ceil(small.count() / shard))
    small = small.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(n_shards).cast("long")))

    lists = small.groupBy("shard").agg(
        F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("lengths")
    )
    islands = lists.select("shard", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "lengths")
    # As many tasks as islands, or some for each shuffle partition; these few rows would else be put together.
    tasks = min(n_shards * ISLANDS, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    islands = kept(_evolved(islands.repartition(tasks, "shard", "island"), capacity, 0))
    for turn in range(1, ROUNDS):
        migrants = islands.select(
            "shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("groups").alias("migrant")
        )
        met = islands.select("shard", "island", "lengths", "groups").join(migrants, ["shard", "island"])
        islands = kept(_evolved(met.repartition(tasks, "shard", "island"), capacity, turn))
    order = F.struct("n_groups", -F.col("fullness"), "island")
    winners = islands.groupBy("shard").agg(F.min_by("groups", order).alias("groups"))

    def placed(rows: pa.Table, won: pa.Table) -> pa.Table:
        numbers = np.frombuffer(won.column("groups")[0].as_py(), np.int32)
        # The order of the lists of lengths; equal lengths by item.
        rows = rows.sort_by([("length", "descending"), ("item", "ascending")])
        length = rows.column("length").to_numpy()
        by_group = np.argsort(numbers, kind="stable")
        ends = np.cumsum(length[by_group])
        first = np.flatnonzero(np.diff(numbers[by_group], prepend=-1))
        before = np.repeat(ends[first] - length[by_group][first], np.diff(np.append(first, len(numbers))))
        offset = np.empty(len(numbers), np.int64)
        offset[by_group] = ends - length[by_group] - before
        sequence = rows.column("shard").to_numpy() * (1 << 32) + numbers
        rows = rows.drop_columns(["shard"])
        rows = rows.append_column("sequence_id", pa.array(sequence, pa.int64()))
        return rows.append_column("offset", pa.array(offset))

    schema = full.schema
    packed = small.groupBy("shard").cogroup(winners.groupBy("shard")).applyInArrow(placed, schema)
    return full.unionByName(packed)


def packed(docs: DataFrame, tokenizer: bytes, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(kept(pieces(docs, tokenizer, capacity, id_col, text_col)), capacity).drop("item")
