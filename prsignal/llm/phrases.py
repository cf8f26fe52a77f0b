"""Phrases whose words keep company, mined by multikey quicksort of suffix pointers.

Texts are cut into pieces and words.  The suffix at each word, cut to the
longest phrase, is a window.  Windows that are equal are counted on the way, in
all the text of a task; those that are left are dealt to tasks by language and
their first three words, so that all windows of a longer phrase meet in one
task.  There a three-way quicksort orders pointers to them word by word: the
rows of an equal partition at depth d are the occurrences of a phrase of d
words, and a partition that holds fewer than ``min_count`` is left at once, with
all that is in it.  The counts of one and two words, by which windows are dealt,
are sums over the same windows.

Before windows move, a sieve of bounded size cuts them: words, pairs and
triples of words are hashed to buckets, and what falls into a bucket with fewer
than ``min_count`` in all texts can be in no phrase that is wanted.  The sieve
only saves work; collisions let more through and nothing is lost.  It has about
one bucket of each kind for 64 bytes of text and 2^26 at most, so where a corpus
outgrows that, windows are cut less, and up to five times the text moves unless
``min_count`` grows with the corpus.

A frequent window is a row of every task that reads texts.  Tasks therefore read
``TASK_BYTES`` of text, unless that leaves cores without work: with many small
tasks, windows times tasks would grow faster than the text.

Only distinct windows are dealt, so copies of a text or a very frequent phrase
add weight to rows but no rows.  A word that very many phrases begin or end
with is joined by several keys.  The best phrases are chosen in parts of a
language first.

Defined results: null text counts as empty, null language as ``und``; a word is
what stands between blanks, tabs and the marks that end a piece, whatever other
characters it has; repeated rows count as often as they occur; texts of any
length are read whole, without a limit on the length of words; other columns
are not looked at; an empty table gives an empty table; ties are ordered by
count and then by the bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prsignal.llm.common import give_back, kept, whole_text

LONGEST = 5
MIN_COUNT = 100
# Leading words that decide which task a window goes to.
LEADING = 3

# Marks that end a piece.  Bytes of the value FF occur in no text.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"\xff"
_PLAIN = bytes.maketrans(BREAKS + b"\t", _BREAK * len(BREAKS) + b" ")

# Bytes of text that are worked on at once.
CHUNK = 1 << 22
# Bytes of text that one task reads at least, where all cores have work.
TASK_BYTES = 1 << 28
# Distinct windows that a task holds, about 140 bytes each, and rows that it gives out at once.
HELD, ROWS = 1_000_000, 50_000
# Windows that one task orders, on average.
WINDOWS_PER_TASK = 500_000
# Buckets of the sieve that make up one row.
BLOCK_BITS = 16
BYTES_PER_BUCKET, FEWEST_BITS, MOST_BITS = 64, BLOCK_BITS, 26
# Keys that a frequent part of phrases is spread over.
SALTS = 8
# Parts of a language whose best phrases are found first.
PARTS = 64


# -- words -----------------------------------------------------------------


def words_of(texts: list[bytes], chunk: int = CHUNK, ahead: int = LONGEST - 1) -> Iterator[tuple[list[bytes], int]]:
    """(words, n): words of texts in order, with ``FF`` where a piece ends; the first n of them are new.

    The others are the words that come next, which windows of the last words
    reach into.
    """
    data = _BREAK.join(texts).lower().translate(_PLAIN).replace(_BREAK, b" \xff ")
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > chunk:
            end = data.rfind(b" ", at, at + chunk)
            if end <= at:
                end = data.find(b" ", at + chunk)
            if end < 0:
                end = len(data)
        words = data[at:end].split()
        own, reach = len(words), 256
        while end < len(data):
            following = data[end : end + reach].split()
            # The last of them may be cut off.
            if len(following) > ahead or end + reach >= len(data):
                words += following[:ahead]
                break
            reach *= 4
        yield words, own
        at = end


class _Numbers(dict):
    """Numbers of words in order of appearance; the break is 0."""

    def __init__(self):
        self[_BREAK] = 0

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _numbered(words: list[bytes], lang: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of each word, hash of each number, word of each number)."""
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    seed = xxhash.xxh3_64_intdigest(lang.encode()) & 0xFFFFFFFF
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w, seed) for w in numbers), np.uint64, len(numbers))
    return ids, hashes, list(numbers)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ ((second << np.uint64(29)) | (second >> np.uint64(35)))
    return mixed * np.uint64(0xD6E8FEB86659FD93)


def _texts_by_language(batches) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about ``CHUNK`` bytes at a time."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        langs = pc.dictionary_encode(batch.column("lang"))
        names = langs.dictionary.to_pylist()
        for lang, text in zip(langs.indices.to_pylist(), texts.to_pylist()):
            lang = names[lang]
            waiting.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            total += len(text)
            if sizes[lang] >= CHUNK:
                total -= sizes.pop(lang)
                yield lang, waiting.pop(lang)
            elif total >= 8 * CHUNK:
                # Many languages, each with little text.
                yield from waiting.items()
                waiting, sizes, total = {}, {}, 0
    yield from waiting.items()


# -- sieve -----------------------------------------------------------------


def _buckets(order: int, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in the sieve of sequences of ``order`` words."""
    return (hashes >> np.uint64(64 - bits)) + np.uint64((order - 1) << bits)


def _count_buckets(batches, bits: int):
    """Rows (block, counts): how often sequences of 1 to ``LEADING`` words of a task fall into a bucket, 255 at most."""
    counts = np.zeros(LEADING << bits, np.uint8)
    for lang, texts in _texts_by_language(batches):
        for words, own in words_of(texts):
            ids, hashes, _ = _numbered(words, lang)
            of_word = hashes[ids]
            at = np.flatnonzero(ids[:own])
            joined = of_word[at]
            for order in range(1, LEADING + 1):
                if order > 1:
                    inside = at + order - 1 < len(ids)
                    at, joined = at[inside], joined[inside]
                    inside = ids[at + order - 1] != 0
                    at, joined = at[inside], joined[inside]
                    joined = _joined(joined, of_word[at + order - 1])
                found, n = np.unique(_buckets(order, joined, bits), return_counts=True)
                counts[found] = np.minimum(counts[found] + n, 255)
    blocks = counts.reshape(-1, 1 << BLOCK_BITS)
    for block in np.flatnonzero(blocks.any(axis=1)):
        packed = pa.compress(blocks[block].tobytes(), codec="zstd", asbytes=True)
        row = [pa.array([block], pa.int32()), pa.array([packed], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, names=["block", "counts"])
    del counts, blocks
    give_back()


def _passing(batches, least: int):
    """Rows (block, bits): the buckets of a block with at least ``least`` in all tasks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            if block not in sums:
                sums[block] = np.zeros(1 << BLOCK_BITS, np.uint64)
            sums[block] += np.frombuffer(pa.decompress(counts, 1 << BLOCK_BITS, "zstd"), np.uint8)
    for block, n in sums.items():
        row = [pa.array([block], pa.int32()), pa.array([np.packbits(n >= least).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, names=["block", "bits"])


def _size(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0


def _bits(size: int) -> int:
    return min(max((size // BYTES_PER_BUCKET).bit_length(), FEWEST_BITS), MOST_BITS)


def in_large_tasks(docs: DataFrame, size: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``docs``, of ``size`` bytes of text, in one task for ``task_bytes`` but as many as there are cores."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes)))


def sieve(docs: DataFrame, min_count: int = MIN_COUNT, bits: int | None = None) -> tuple[int, np.ndarray]:
    """(bits, passing buckets as a bit array): buckets of words, pairs and triples that ``min_count`` may be in.

    At most LEADING * 2^(MOST_BITS - 3) bytes, 24 MB, reach the driver, whatever the size of ``docs`` (lang, text).
    """
    if bits is None:
        bits = _bits(_size(docs))
    least = min(min_count, 255)
    counted = docs.mapInArrow(lambda b: _count_buckets(b, bits), "block int, counts binary")
    passing = counted.repartition("block").mapInArrow(lambda b: _passing(b, least), "block int, bits binary")
    table = np.zeros((LEADING << bits) // 8, np.uint8)
    width = (1 << BLOCK_BITS) // 8
    for row in passing.collect():
        table[row.block * width : (row.block + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return bits, table


def _passes(table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Whether the buckets' bits are set."""
    in_byte = np.uint8(7) - (buckets & np.uint64(7)).astype(np.uint8)
    return (table[buckets >> np.uint64(3)] >> in_byte) & np.uint8(1) == 1


# -- windows ---------------------------------------------------------------


def _given_out(held: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, words, n) of what is held, which is empty then."""
    while held:
        lang, sums = held.popitem()
        while sums:
            rows = [sums.popitem() for _ in range(min(len(sums), ROWS))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(rows), pa.string()),
                    pa.array([words for words, _ in rows], pa.binary()).cast(pa.string()),
                    pa.array([n for _, n in rows], pa.int64()),
                ],
                names=["lang", "words", "n"],
            )


def _windows(batches, bits: int, table: np.ndarray, longest: int, most: int = HELD):
    """Rows (lang, words, n): distinct windows of a task's texts, and the number of all words (words null).

    Windows of all stretches of text are summed up; when more than ``most`` are held, the rarer half is given out.
    """
    held: dict[str, dict] = {}
    for lang, texts in _texts_by_language(batches):
        for words, own in words_of(texts, ahead=longest - 1):
            ids, hashes, names = _numbered(words, lang)
            of_word = hashes[ids]
            starts = np.flatnonzero(_passes(table, _buckets(1, hashes, bits))[ids] & (ids != 0))
            # How many words from each place on the sieve lets through, by LEADING at a time.
            reach = np.zeros(len(ids) + longest, np.int64)
            reach[starts] = 1
            at, joined = starts, of_word[starts]
            for order in range(2, LEADING + 1):
                inside = reach[at + order - 1] > 0
                at, joined = at[inside], _joined(joined[inside], of_word[at[inside] + order - 1])
                fine = _passes(table, _buckets(order, joined, bits))
                at, joined = at[fine], joined[fine]
                reach[at] = order
            # Places whose full reach overlaps that of the next go on.
            depth = reach.copy()
            full = reach == LEADING
            for _ in range(LEADING, longest):
                depth[:-1] = np.where(full[:-1], np.maximum(depth[:-1], np.minimum(depth[1:] + 1, longest)), depth[:-1])
            starts = starts[starts < own]
            depth = np.minimum(depth[starts], longest)
            padded = np.concatenate([ids, np.zeros(longest, np.int64)])
            columns = [np.where(depth > d, padded[starts + d], 0) for d in range(longest)]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            new = np.ones(len(order), bool)
            if len(order):
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            heads = np.flatnonzero(new)
            n = np.diff(np.append(heads, len(order)))
            rows = [b" ".join(names[w] for w in row if w) for row in zip(*(c[heads].tolist() for c in columns))]
            sums = held.setdefault(lang, {})
            for window, times in zip(rows, n.tolist()):
                sums[window] = sums.get(window, 0) + times
            sums[None] = sums.get(None, 0) + int(np.count_nonzero(ids[:own]))
            if sum(map(len, held.values())) > most:
                # The frequent ones stay, as they are likely to come again.
                middle = np.median([times for sums in held.values() for times in sums.values()])
                rare = {lang: [w for w, times in sums.items() if times <= middle] for lang, sums in held.items()}
                yield from _given_out({lang: {w: held[lang].pop(w) for w in some} for lang, some in rare.items()})
    yield from _given_out(held)
    give_back()


# -- quicksort -------------------------------------------------------------


def frequent_prefixes(
    words: np.ndarray, weights: np.ndarray, least: int, shortest: int = 1
) -> Iterator[tuple[int, int, int]]:
    """(row, depth, weight): for each sequence of words that rows of this weight begin with, one of these rows.

    ``words`` has a row for each window, with a 0 behind its last word.  Pointers
    to rows are parted in three by the word at a depth: less than, equal to and
    greater than a pivot.  Partitions of less than ``least`` are abandoned.
    """
    waiting = [(np.arange(len(words)), 0)]
    while waiting:
        pointers, depth = waiting.pop()
        if not len(pointers):
            continue
        key = words[pointers, depth]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        for side in (pointers[key < pivot], pointers[key > pivot]):
            if weights[side].sum() >= least:
                waiting.append((side, depth))
        equal = pointers[key == pivot]
        weight = int(weights[equal].sum())
        if pivot and weight >= least:
            if depth + 1 >= shortest:
                yield int(equal[0]), depth + 1, weight
            if depth + 1 < words.shape[1]:
                waiting.append((equal, depth + 1))


def _sorted_counts(batches, least: int, longest: int):
    """Rows (lang, phrase, n): the phrases of more than two words in all windows of this task."""
    numbers: dict[str, _Numbers] = {}
    parts: dict[str, list] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        windows = batch.column("words").cast(pa.binary()).to_pylist()
        counts = batch.column("n").to_numpy()
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by_lang.setdefault(lang, []).append(i)
        for lang, rows in by_lang.items():
            number = numbers.setdefault(lang, _Numbers())
            table = np.zeros((len(rows), longest), np.int32)
            for at, i in enumerate(rows):
                ids = [number[w] for w in windows[i].split(b" ")]
                table[at, : len(ids)] = ids
            parts.setdefault(lang, []).append((table, counts[rows]))
    for lang, tables in parts.items():
        words = np.concatenate([t for t, _ in tables])
        weights = np.concatenate([n for _, n in tables])
        names = list(numbers[lang])
        found = []
        for row, depth, n in frequent_prefixes(words, weights, least, LEADING):
            found.append((b" ".join(names[w] for w in words[row, :depth]).decode(), n))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(found), pa.string()),
                pa.array([p for p, _ in found], pa.string()),
                pa.array([n for _, n in found], pa.int64()),
            ],
            names=["lang", "phrase", "n"],
        )
    del numbers, parts
    give_back()


def _n_words(phrase: str) -> Column:
    return F.size(F.split(phrase, " "))


def counted(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all phrases of 1 to ``longest`` words with n >= min_count, (lang, n) of all words)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    size = _size(texts)
    texts = in_large_tasks(texts, size)
    bits, table = sieve(texts, min_count, _bits(size) if bits is None else bits)
    shared = spark.sparkContext.broadcast(table)
    found = texts.mapInArrow(
        lambda b: _windows(b, bits, shared.value, longest), "lang string, words string, n long"
    )
    windows = kept(found.groupBy("lang", "words").agg(F.sum("n").alias("n")))
    totals = windows.where("words IS NULL").select("lang", "n")
    windows = windows.where("words IS NOT NULL")

    leading = F.array_distinct(F.array(*(F.substring_index("words", " ", k) for k in range(1, LEADING))))
    short = (
        windows.select("lang", F.explode(leading).alias("phrase"), "n")
        .groupBy("lang", "phrase")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_count)
    )
    long = windows.where(_n_words("words") >= LEADING)
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), -(-windows.count() // WINDOWS_PER_TASK)
    )
    longer = long.repartition(tasks, "lang", F.substring_index("words", " ", LEADING)).mapInArrow(
        lambda b: _sorted_counts(b, min_count, longest), "lang string, phrase string, n long"
    )
    return kept(short.unionByName(longer)), totals


# -- scores ----------------------------------------------------------------


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two words and more, by their weakest cut."""
    words = F.split("phrase", " ")
    several = phrases.where(_n_words("phrase") > 1).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = several.select(
        "lang", "phrase", "a", "w", salt.alias("salt"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "salt", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"),
    )
    every = F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt")
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"), every)
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"), every)
    joined = (
        cuts.join(heads, ["lang", "head", "salt"])
        .join(tails, ["lang", "tail", "salt"])
        .join(totals.select("lang", "n"), "lang")
    )
    # Decimals of 38 digits: the products are exact, and div gives the whole part.
    score = F.expr(
        "(CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(15, 0)) * CAST(1000 AS DECIMAL(4, 0)))"
        " div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))"
    )
    cut = F.struct(score.alias("score"), "k", "l", "r")
    return (
        joined.groupBy("lang", "phrase", "a", "n")
        .agg(F.min(cut).alias("c"))
        .select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    )


def uncovered(candidates: DataFrame) -> DataFrame:
    """Candidates without those whose words lie inside a longer one that is as frequent.

    If a longer phrase is as frequent, so is every phrase between the two.  It is
    therefore enough to look at the two phrases that are one word shorter.
    """
    words = F.split("phrase", " ")
    parts = F.array(
        F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "),
        F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " "),
    )
    inside = (
        candidates.where(_n_words("phrase") > 2)
        .select("lang", F.explode(parts).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("most"))
    )
    return candidates.join(inside, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, best: int = 2000, longest: int = LONGEST, bits: int | None = None
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of 2 to ``longest`` words of each language.

    ``docs`` has lang and text.  a is the number of occurrences of the phrase, l
    and r of the two parts of its weakest cut, n of all words, and score
    floor(1000 a n / (l r)).
    """
    phrases, totals = counted(docs, min_count, longest, bits)
    found = uncovered(scored(phrases, totals))
    by_rank = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    ahead = Window.partitionBy("lang", "part").orderBy(*by_rank)
    some = found.withColumn("part", part).withColumn("nth", F.row_number().over(ahead)).where(F.col("nth") <= best)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*by_rank))
    return (
        some.withColumn("rank", rank)
        .where(F.col("rank") <= best)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
