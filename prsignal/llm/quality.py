"""Quality scores of documents: random Fourier features, ridge regression, isotonic calibration.

A document is described by the statistics named in ``STATISTICS``, counted over
its whole text.  Standardised, they go through FEATURES random cosines, whose
products approximate a Gaussian kernel.  The normal equations of a ridge
regression on the label are sums over rows: each task sums its rows, and the
sums of the tasks are added by row of the matrix, so what reaches the driver has
a fixed size.  The raw scores are then counted in fixed bins with their labels,
and isotonic regression over the bins gives the share of good documents.

All labelled rows that are not held out are used.  Defined results: null counts
as empty, and an empty text is scored like any other; a label that is null is
not used; a row labelled several times counts as often; without any label every
score is 0.5; equal texts get equal scores; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prsignal.llm.common import kept, map_slices, type_of, whole_text

FEATURES, SEED, RIDGE = 256, 7, 1.0
BINS, LOWEST, HIGHEST = 2000, -0.5, 1.5
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "words_in_line",
    "line_length_spread", "sentence_ends", "commas", "exclamations", "pipes", "symbols", "digits",
    "upper", "spaces", "wide", "distinct_words", "commonest_word", "short_words", "repeated_lines",
    "title_words", "long_words", "repeated_words",
)

_WORD = re.compile(r"\S+")


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(characters.encode())] = 1
    return out


_CLASSES = np.stack(
    [
        _class("."),
        _class(","),
        _class("!"),
        _class("|"),
        _class("#$%&*@^~=+<>_{}[]\\/"),
        _class("0123456789"),
        _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        _class(" \t\n\r"),
        (np.arange(256) >= 128).astype(float),
    ]
)


def statistics(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    shares = _CLASSES @ np.bincount(data, minlength=256) / max(len(data), 1)
    words, lines = text.split(), [line for line in text.split("\n") if line]
    n, n_lines = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    widths = np.fromiter(map(len, lines), float, len(lines)) if lines else np.zeros(1)
    counts = Counter(words)
    ends, commas, exclaims, pipes, symbols, digits, upper, spaces, wide = shares
    per_word = len(data) / n
    return np.array(
        [
            np.log1p(len(text)),
            np.log1p(len(words)),
            np.log1p(len(lines)),
            lengths.mean(),
            lengths.std(),
            np.log1p(len(words) / n_lines),
            widths.std() / (widths.mean() + 1),
            ends * per_word,
            commas * per_word,
            exclaims * per_word,
            pipes * per_word,
            symbols * per_word,
            digits * per_word,
            upper * per_word,
            spaces * per_word,
            wide * per_word,
            len(counts) / n,
            max(counts.values(), default=0) / n,
            (lengths <= 3).sum() / n,
            1 - len(set(lines)) / n_lines if lines else 0.0,
            sum(map(str.istitle, words)) / n,
            (lengths >= 12).sum() / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
        ]
    )


def described(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, stats array<double>) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = [statistics(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["id", "stats"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = map_slices(rows, run, f"id {type_of(rows, 'id')}, stats array<double>")
    return out.withColumnRenamed("id", id_col)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    scores: np.ndarray | None = None  # ascending raw scores, and what they are calibrated to
    shares: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = len(STATISTICS)
        directions = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES))
        shifts = rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.cos(x @ directions + shifts) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.scores, self.shares), 0, 1)


def _sums(rows: DataFrame, width: int, add) -> dict[int, np.ndarray]:
    """Rows of a matrix that is a sum over all rows of a table, added up within tasks, then by matrix row."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = add(batch.slice(at, 4096))
                total = part if total is None else total + part
        if total is not None:
            keys = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.array(list(total), pa.list_(pa.float64()))], ["k", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + v.values.to_numpy()
        if sums:
            values = pa.array(list(sums.values()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), values], ["k", "v"])

    schema = "k int, v array<double>"
    parts = rows.mapInArrow(of_task, schema).repartition("k").mapInArrow(added, schema)
    return {r["k"]: np.array(r["v"]) for r in parts.collect()}


def _isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to the values: neighbours out of order are merged."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks])


def fit(labelled: DataFrame) -> Model:
    """A model from (stats, label) rows with labels 0 and 1."""
    rows = labelled.select("stats", F.col("label").cast("double").alias("label")).where("label IS NOT NULL")
    d = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column(0))
        return np.stack([np.full(d, float(len(x))), x.sum(0), (x * x).sum(0)])

    sums = _sums(rows, d, moments)
    if not sums:
        return Model(np.zeros(d), np.ones(d))
    n = sums[0][0]
    mean = sums[1] / n
    model = Model(mean, np.sqrt(np.maximum(sums[2] / n - mean**2, 1e-12)) + 1e-6)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(matrix(batch.column(0)))
        return np.vstack([z.T @ z, batch.column(1).to_numpy() @ z])

    sums = _sums(rows, FEATURES + 1, products)
    gram = np.stack([sums[k] for k in range(FEATURES + 1)])
    penalty = np.full(FEATURES + 1, RIDGE)
    penalty[-1] = 0
    model.weights = np.linalg.solve(gram + np.diag(penalty) + 1e-9 * np.eye(FEATURES + 1), sums[FEATURES + 1])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        raw = model.raw(matrix(batch.column(0)))
        k = np.clip((raw - LOWEST) / (HIGHEST - LOWEST) * BINS, 0, BINS - 1).astype(int)
        label = batch.column(1).to_numpy()
        return np.stack([np.bincount(k, w, BINS) for w in (np.ones(len(k)), label, raw)])

    sums = _sums(rows, BINS, binned)
    full = sums[0] > 0
    count, good, raw = (sums[k][full] for k in range(3))
    shares = _isotonic(good / count, count)
    # One point for each block: its mean raw score, so that scores between blocks are interpolated.
    starts = np.flatnonzero(np.diff(shares, prepend=-1))
    weight = np.add.reduceat(count, starts)
    model.scores, model.shares = np.add.reduceat(raw, starts) / weight, shares[starts]
    return model


def score(stats: DataFrame, model: Model, id_col="doc_id") -> DataFrame:
    """(id, score, predicted) of every described row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = model.score(matrix(batch.column(1)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))],
            ["id", "score", "predicted"],
        )

    rows = stats.select(F.col(id_col).alias("id"), "stats")
    out = map_slices(rows, run, f"id {type_of(rows, 'id')}, score double, predicted int", rows=4096)
    return out.withColumnRenamed("id", id_col)


def scored(docs: DataFrame, labels: DataFrame, used: Column, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """(id, score, predicted) of every document; ``used`` says of an id whether its labels may be learned from."""
    stats = kept(described(docs, id_col, text_col))
    learned = labels.where(used).select(id_col, F.col(label_col).alias("label"))
    model = fit(stats.join(learned, id_col))
    return score(stats, model, id_col)
