"""Word vectors (skip-gram with hierarchical softmax), fitted and applied without a vocabulary in one place.

The driver holds one number pair for each count that words have, which is all
that the Huffman tree hangs on; a task holds the words of its block of text.
Every word counts, and every line is trained on.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.session import materialize, materialize_last

# As Spark's Word2Vec has them: words either side at most, words of a sentence, step, products beyond which nothing is learned.
WINDOW = 5
MAX_SENTENCE = 1000
STEP = 0.025
MAX_PRODUCT = 6.0
# Blocks of text, each trained by one task: so many at least, and of so many bytes about.
MIN_BLOCKS = 8
BLOCK_BYTES = 8 << 20
# Copies of a text that a block gets together have so many bytes at most.
COPIES_BYTES = 100_000
# Positions of a batch before it is parted by width, and updates of one vector that a part adds up rather than averages.
BATCH = 4096
ADDED = 32
# Words whose vectors are summed up at once where vectors are applied.
WORDS_AT_ONCE = 100_000


def joined_words(column: str) -> Column:
    """The words of an array as one text; words hold no blank."""
    return F.array_join(F.col(column), " ")


def _block_of(spark: SparkSession, n: int, *key: str) -> Column:
    """One of ``n`` blocks by hash of the key, numbered so that ``repartition(n, block)`` gives each a partition."""
    ids, wanted = spark.range(0, 40 * n + 200, numPartitions=1), set(range(n))
    numbers = {r.at: r.id for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()}
    labels = F.array(*[F.lit(numbers.get(k, k)).cast("bigint") for k in sorted(wanted)])
    return F.element_at(labels, (F.pmod(F.xxhash64(*key), F.lit(n)) + 1).cast("int"))


# -- the tree --------------------------------------------------------------


def huffman(counts: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Huffman tree of words from (count, words with it), in order of counts: (runs of siblings, root).

    Words are numbered in order of their counts, inner nodes behind them.
    Nodes of one weight are joined two by two, all at once, so a run of them is
    one row (first child, first parent, code of the first child).
    """
    heap, node = [], 0
    for count, words in counts:
        heap.append((count, node, words))
        node += words
    heapq.heapify(heap)
    runs = []
    while heap:
        weight, first, n = heapq.heappop(heap)
        if n > 1:
            runs.append((first, node, 0))
            heapq.heappush(heap, (2 * weight, node, n // 2))
            node += n // 2
            if n % 2:
                heapq.heappush(heap, (weight, first + n - 1, 1))
        elif heap:
            other, second, m = heapq.heappop(heap)
            runs += [(first, node, 0), (second, node, 1)]
            heapq.heappush(heap, (weight + other, node, 1))
            node += 1
            if m > 1:
                heapq.heappush(heap, (other, second + 1, m - 1))
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 3), node - 1


def paths(words: np.ndarray, runs: np.ndarray, root: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner nodes above each word, and the code of the step from each; -1 behind the root."""
    nodes, codes, at = [], [], words.astype(np.int64)
    while (below := (at >= 0) & (at != root)).any():
        first, parent, code = runs[np.searchsorted(runs[:, 0], at, "right") - 1].T
        codes.append(np.where(below, (at - first + code) % 2, -1).astype(np.int8))
        at = np.where(below, parent + (at - first) // 2, -1)
        nodes.append(at)
    if not nodes:
        return np.empty((len(words), 0), np.int64), np.empty((len(words), 0), np.int8)
    return np.stack(nodes, 1), np.stack(codes, 1)


def first_vectors(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Small random vectors that hang on the word's number and the seed only, so that all tasks begin with the same."""
    x = words.astype(np.uint64)[:, None] * np.uint64(size) + np.arange(size, dtype=np.uint64)
    x += np.uint64(seed % (1 << 32)) << np.uint64(32)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x + np.uint64(0x9E3779B97F4A7C15) ^ x >> np.uint64(shift)) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float64) / (1 << 24) - 0.5) / size).astype(np.float32)


# -- training of a block ---------------------------------------------------


def sentences(ids: np.ndarray, ends: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Known words (-1: unknown) of texts and their repeats one after the other, and the sentence of each."""
    known = ids >= 0
    ends = np.concatenate([[0], np.cumsum(known)])[ends]
    ids = ids[known]
    rows = np.repeat(np.arange(len(copies)), copies)
    sizes = np.diff(ends)[rows]
    before = np.cumsum(sizes) - sizes
    within = np.arange(sizes.sum()) - np.repeat(before, sizes)
    words = ids[np.repeat(ends[:-1][rows], sizes) + within]
    start = within % MAX_SENTENCE == 0
    return words.astype(np.int32), np.cumsum(start, dtype=np.int32)


class _Vectors:
    """Vectors that batches of changes are added to."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.times = rows, np.zeros(len(rows), np.float32)

    def add(self, at: np.ndarray, changes: np.ndarray, n: np.ndarray) -> None:
        """Add ``changes``, sums of ``n`` each; of more than ADDED for one vector, their mean as often."""
        at, size = at.reshape(-1), self.rows.shape[1]
        np.add.at(self.times, at, n.reshape(-1).astype(np.float32))
        scale = ADDED / np.maximum(self.times.take(at), ADDED)
        self.times[at] = 0
        changes = changes.reshape(-1, size) * scale[:, None]
        places = at.astype(np.int64)[:, None] * size + np.arange(size)
        np.add.at(self.rows.reshape(-1), places.reshape(-1), changes.reshape(-1))


def _learn(vectors: _Vectors, inner: _Vectors, words, sentence, nodes, wanted, sizes, at, width, step) -> None:
    """One update from the positions ``at`` and the words up to ``width`` either side of them."""
    near = at[:, None] + np.array([k for k in range(-width, width + 1) if k])
    there = (near >= 0) & (near < len(words))
    near[~there] = 0
    there &= sentence.take(near) == sentence.take(at)[:, None]
    centre, context = words.take(at), words.take(near)
    size = sizes.take(centre)
    depth = int(size.max())
    path, on_path = nodes.take(centre, axis=0)[:, :depth], np.arange(depth) < size[:, None]
    h, p = vectors.rows.take(context, axis=0), inner.rows.take(path, axis=0)
    f = h @ np.ascontiguousarray(p.transpose(0, 2, 1))
    learned = np.abs(f) < MAX_PRODUCT
    learned &= there[:, :, None]
    learned &= on_path[:, None, :]
    np.clip(f, -MAX_PRODUCT, MAX_PRODUCT, out=f)
    g = wanted.take(centre, axis=0)[:, None, :depth] - 1 / (1 + np.exp(-f))
    g *= learned
    g *= np.float32(step)
    # What is not learned from changes nothing, wherever it points.
    for_context, for_inner = g @ p, g.transpose(0, 2, 1) @ h
    vectors.add(context, for_context, there)
    inner.add(path, for_inner, there.sum(1)[:, None] * on_path)


def trained(
    words: np.ndarray, sentence: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, codes: np.ndarray, seed: int
) -> np.ndarray:
    """The vectors after one pass over a block's words; ``nodes`` and ``codes`` are each word's path."""
    named = pa.array(nodes.reshape(-1)).dictionary_encode()
    nodes, wanted = named.indices.to_numpy().reshape(nodes.shape), (1 - codes).astype(np.float32)
    changed, inner = _Vectors(vectors), _Vectors(np.zeros((len(named.dictionary), vectors.shape[1]), np.float32))
    sizes = (codes >= 0).sum(1)
    if not nodes.shape[1]:
        return vectors
    chance = np.random.default_rng(seed)
    for start in range(0, len(words), BATCH):
        at = np.arange(start, min(start + BATCH, len(words)))
        widths = chance.integers(1, WINDOW + 1, len(at))
        step = STEP * max(1 - start / len(words), 1e-4)
        # Positions of one width and of paths about as long are learned together, so that little is computed for nothing.
        for width in chance.permutation(WINDOW) + 1:
            some = at[widths == width]
            some = some[np.argsort(sizes[words[some]], kind="stable")]
            for part in np.array_split(some, 2):
                if len(part):
                    _learn(changed, inner, words, sentence, nodes, wanted, sizes, part, int(width), step)
    return vectors


def _ids(texts: pa.ChunkedArray, words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` of the words of all texts, -1 for others, and where each text's begin and the last ends."""
    parts = pc.split_pattern(texts, " ").combine_chunks()
    ends = parts.offsets.to_numpy().astype(np.int64)
    ids = pc.fill_null(pc.index_in(parts.values, value_set=words.combine_chunks()), -1).to_numpy()
    return ids[ends[0] : ends[-1]].astype(np.int64), ends - ends[0]


def _train_block(size: int, seed: int, runs: np.ndarray, root: int):
    def train(texts: pa.Table, words: pa.Table) -> pa.Table:
        # Texts come in any order: it is fixed here, so that reruns agree.
        texts, words = texts.sort_by("tie"), words.sort_by("at")
        number = words["at"].to_numpy()
        vectors = first_vectors(number, size, seed)
        if texts.num_rows and words.num_rows:
            ids, ends = _ids(texts["text"], words["word"])
            vectors = trained(*sentences(ids, ends, texts["copies"].to_numpy()), vectors, *paths(number, runs, root), seed)
        flat = pa.array(vectors.reshape(-1))
        offsets = pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32))
        return pa.table({"word": words["word"], "vector": pa.ListArray.from_arrays(offsets, flat)})

    return train


# -- fitting and applying --------------------------------------------------


def _numbered(words: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Words with their place (``at``) in order of count and word; and how many words have each count."""
    ordered = materialize(words.orderBy("n", "word").withColumn("id", F.monotonically_increasing_id()))
    part, within = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r["count"] for r in ordered.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for k in range(max(sizes, default=0) + 1):
        before.append(F.lit(total).cast("bigint"))
        total += sizes.get(k, 0)
    at = F.element_at(F.array(*before), (part + 1).cast("int")) + within
    counts = [(r.n, r["count"]) for r in ordered.groupBy("n").count().orderBy("n").collect()]
    return ordered.select("word", at.alias("at")), counts


def fit_word_vectors(
    df: DataFrame, column: str, output: str, vector_size: int = 100, min_count: int = 5, seed: int = 42
) -> WordVectorsModel:
    """Vectors of all words that occur ``min_count`` times in an array column, trained on all rows in one pass.

    Each block of text is trained by one task from the same first vectors, and
    a word's vector is the mean over the blocks that have it, as in Spark's
    Word2Vec.  Equal texts are counted once and trained on as often as they occur.
    """
    table = materialize_last(df.sparkSession, lambda: _fitted(df, column, vector_size, min_count, seed))
    return WordVectorsModel(inputCol=column, outputCol=output)._of(table, vector_size)


def _fitted(df: DataFrame, column: str, vector_size: int, min_count: int, seed: int) -> DataFrame:
    texts = df.select(joined_words(column).alias("text")).where("text <> ''")
    texts = materialize(texts.groupBy("text").agg(F.count(F.lit(1)).alias("n")))
    n_bytes = texts.agg(F.sum(F.octet_length("text") * F.col("n"))).first()[0] or 0
    n_blocks = max(MIN_BLOCKS, -(-n_bytes // BLOCK_BYTES))
    together = f"greatest(CAST({COPIES_BYTES} div octet_length(text) AS BIGINT), 1L)"
    blocks = (
        texts.selectExpr("text", "n", f"explode(sequence(0L, n - 1, {together})) AS first")
        .selectExpr("text", "first", f"least({together}, n - first) AS copies", "xxhash64(text, first) AS tie")
        .withColumn("block", _block_of(df.sparkSession, n_blocks, "text", "first"))
        .select("block", "tie", "text", "copies")
        .repartition(n_blocks, "block")
    )
    words = blocks.select("block", "copies", F.explode(F.split("text", " ")).alias("word"))
    words = materialize(words.groupBy("block", "word").agg(F.sum("copies").alias("n")))
    numbered, counts = _numbered(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    if not counts:
        raise ValueError(f"no word occurs {min_count} times")
    known = words.select("block", "word").join(numbered, "word").repartition(n_blocks, "block")
    train = _train_block(vector_size, seed, *huffman(counts))
    by_block = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        train, "word string, vector array<float>"
    )
    names = [f"x{i}" for i in range(vector_size)]
    means = [F.avg(F.col("vector")[i].cast("double")).cast("float").alias(x) for i, x in enumerate(names)]
    return by_block.groupBy("word").agg(*means).select("word", F.array(*names).alias("vector"))


def _mean_of_block(size: int):
    def means(texts: pa.Table, words: pa.Table) -> pa.Table:
        ids, ends = _ids(texts["text"], words["word"])
        flat = words["vector"].combine_chunks().flatten().to_numpy().astype(np.float64)
        # The last row is that of unknown words.
        vectors = np.vstack([flat.reshape(-1, size), np.zeros((1, size))])
        out = np.zeros((texts.num_rows, size))
        for start in range(0, len(ids), WORDS_AT_ONCE):
            some = vectors[ids[start : start + WORDS_AT_ONCE]]
            first, last = np.searchsorted(ends, [start, start + len(some) - 1], "right") - 1
            out[first : last + 1] += np.add.reduceat(some, np.maximum(ends[first : last + 1] - start, 0), axis=0)
        out /= np.diff(ends)[:, None]
        offsets = pa.array(np.arange(0, out.size + 1, size, dtype=np.int32))
        vector = pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))
        return pa.table({"key": texts["key"], "vector": vector})

    return means


class WordVectorsModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Adds the mean vector of a row's words, those without a vector counted as zero.

    Vectors stay in a table: each distinct text meets the vectors of its words
    in a task that has a block of texts, and its mean goes to the rows that have the text.
    """

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _of(self, table: DataFrame, size: int) -> WordVectorsModel:
        self.table, self.size = table, size
        return self

    def copy(self, extra=None):
        return super().copy(extra)._of(self.table, self.size)

    def getVectors(self) -> DataFrame:
        """(word, vector)."""
        return self.table.select("word", array_to_vector(F.col("vector").cast("array<double>")).alias("vector"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, column = dataset.sparkSession, self.getInputCol()
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        texts = dataset.select(joined_words(column).alias("text")).where("text <> ''").distinct()
        texts = texts.withColumn("block", _block_of(spark, n, "text")).repartition(n, "block")
        words = texts.select(F.col("block").alias("of_block"), F.explode(F.split("text", " ")).alias("word")).distinct()
        known = words.join(self.table, "word").select("of_block", "word", "vector").repartition(n, "of_block")
        key = F.unhex(F.md5("text"))
        means = (
            texts.select("block", "text", key.alias("key")).groupBy("block").cogroup(known.groupBy("of_block"))
            .applyInArrow(_mean_of_block(self.size), "key binary, vector array<double>")
            .withColumnsRenamed({"key": "_words_key", "vector": "_words_vector"})
        )
        zeros = F.array(*[F.lit(0.0)] * self.size)
        return (
            dataset.withColumn("_words_key", F.unhex(F.md5(joined_words(column))))
            .join(means, "_words_key", "left")
            .select(
                *[F.col(f"`{c}`") for c in dataset.columns],
                array_to_vector(F.coalesce("_words_vector", zeros)).alias(self.getOutputCol()),
            )
        )

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: WordVectorsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"size": self.model.size})
        self.model.table.write.parquet(f"{path}/vectors")


class _Reader(MLReader):
    def load(self, path: str) -> WordVectorsModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = WordVectorsModel()._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        table = self.sparkSession.read.schema("word string, vector array<float>").parquet(f"{path}/vectors")
        return model._of(table, metadata["size"])
