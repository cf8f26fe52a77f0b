"""Language identification by averaged hashed subword embeddings.

A text is lower-cased, everything but letters becomes a space, and each run of
two to four characters is a subword, hashed to a row of an embedding table.  The
mean of these rows goes through one linear layer and a softmax.  Table and layer
are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows; one part of the sample is kept from training, to fit the
temperature of the softmax and the score below which a prediction is rejected.

The sample: rows with a known language and at most ``SAMPLE_CHARS`` characters,
up to ``SAMPLE_PER_LANG`` for a language and ``SAMPLE_ROWS`` in all, those whose
id has the smallest hash.  Every row is predicted, from its whole text.

Defined results: ``und`` with score 0 where the text is null or has no letter, or
where nothing could be learned; equal texts get equal results; rows are
independent; only text and id are read for a prediction, so extra columns change
nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prsignal.llm.common import map_slices, type_of, whole_text

SAMPLE_ROWS, SAMPLE_PER_LANG, SAMPLE_CHARS = 4000, 600, 20_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 16, 5, 0.5
SIZES = (2, 3, 4)
UNKNOWN = "und"

# Characters that are looked at in one step; bounds the memory for long texts.
BLOCK = 1 << 18

# Share of the right predictions among the kept-back rows that may be rejected.
REJECTED = 0.002


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def subwords(text: str):
    """Blocks of embedding rows, one for each subword of the text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, np.uint32(32))
    wanted = points != 32
    wanted[1:] |= points[:-1] != 32
    points = np.concatenate([[32], points[wanted], [32]]).astype(np.uint32)
    for at in range(0, len(points), BLOCK):
        block = points[at : at + BLOCK + SIZES[-1] - 1]
        for n in SIZES:
            count = min(len(block) - n + 1, BLOCK)
            if count <= 0:
                continue
            h = np.full(count, n, np.uint32)
            for i in range(n):
                h = (h ^ block[i : i + count]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            yield h * np.uint32(0x9E3779B1) >> np.uint32(16)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # for each subword, what it adds to the score of each language
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for rows in subwords(text):
            total += self.table[rows].sum(0, dtype=np.float64)
            n += len(rows)
        return total / max(n, 1) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        x = self.logits(text) / self.temperature
        p = np.exp(x - x.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model:
    """A model from (text, language) pairs."""
    rows = [(t, lang) for t, lang in rows if has_letter(t)]
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    own = {lang: k for k, lang in enumerate(langs)}
    bags = []
    for text, lang in rows:
        ids, counts = np.unique(np.concatenate(list(subwords(text))), return_counts=True)
        bags.append((ids, (counts / counts.sum()).astype(np.float32), own[lang], text))
    order = rng.permutation(len(bags))
    back = max(1, len(bags) // 5) if len(bags) >= 10 else 0
    checked, used = order[:back], order[back:]

    embedding = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((len(langs), DIM), np.float32)
    bias = np.zeros(len(langs), np.float32)
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in rng.permutation(used):
            ids, share, k, _ = bags[i]
            mean = share @ embedding[ids]
            x = layer @ mean + bias
            error = np.exp(x - x.max())
            error /= error.sum()
            error[k] -= 1
            down = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= rate * np.float32(0.1) * error
            # A row moves by its share of the text, relative to the largest share in it.
            embedding[ids] -= (rate * share / share.max())[:, None] * down
    model = Model(langs, embedding @ layer.T, bias.astype(np.float64))
    return calibrated(model, [(bags[i][3], bags[i][2]) for i in checked])


def calibrated(model: Model, rows: list[tuple[str, int]]) -> Model:
    """Fit temperature and rejection to rows that training has not seen."""
    if not rows:
        return model
    x = np.array([model.logits(text) for text, _ in rows])
    k = np.array([k for _, k in rows])

    def loss(temperature: float) -> float:
        z = x / temperature
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(k)), k]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    right = [p for (text, own) in rows for lang, p in [model.predict(text)] if lang == model.langs[own]]
    model.least = float(min(0.5, np.quantile(right, REJECTED))) if right else 0.0
    return model


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", held_out: Column | None = None) -> Model:
    """Train on the documented sample of the rows that are not held out."""
    rows = docs.select(
        F.col(lang_col).alias("lang"),
        F.xxhash64(F.col(id_col).cast("string"), text_col).alias("hash"),
        F.col(text_col).alias("text"),
        (F.lit(False) if held_out is None else held_out).alias("held_out"),
    )
    rows = rows.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.col("held_out") & (F.length("text") <= SAMPLE_CHARS)
    )
    # Languages and hashes are ranked without the texts, which only the chosen rows bring.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = (
        rows.select("lang", "hash")
        .distinct()
        .withColumn("rank", rank)
        .where(F.col("rank") <= SAMPLE_PER_LANG)
        .orderBy("rank", "lang")
        .limit(SAMPLE_ROWS)
    )
    sample = (
        rows.select("lang", "hash", "text")
        .join(F.broadcast(chosen), ["lang", "hash"])  # at most SAMPLE_ROWS rows
        .dropDuplicates(["lang", "hash"])
        .orderBy("rank", "lang")
        .select("text", "lang")
    )
    return train([tuple(r) for r in sample.collect()])


def predict(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row."""
    # A table of BUCKETS rows by at most SAMPLE_ROWS languages, whatever the data.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        got = [m.predict(t) for t in batch.column(1).to_pylist()]
        lang = pa.array([x for x, _ in got], pa.string())
        score = np.array([p for _, p in got], np.float64)
        rejected = (score < m.least) | np.array([x == UNKNOWN for x, _ in got], bool)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), lang, pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"]
        )

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    schema = f"id {type_of(rows, 'id')}, lang_pred string, score double, rejected boolean"
    return map_slices(rows, run, schema).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        got = [m.predict(t or "") for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array([lang != UNKNOWN and p >= m.least for lang, p in got], pa.bool_()))

    return map_slices(docs, run, docs.schema)
