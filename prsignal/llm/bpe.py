"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

The model holds one piece per rank.  Its bytes are mapped to the characters
from U+0100 on, its score is the negative rank, and its normaliser changes
nothing, so that merging by best score is merging by lowest rank.  A text is cut
by the pre-token pattern; a pre-token that is itself in the vocabulary is its
own id, any other is merged by the model.  Ids decode by the inverse table.

Defined results: null and empty texts give no ids; texts of any length are
encoded whole; rows are independent, so repeated rows, ties and extra columns
change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prsignal.llm.common import map_slices, type_of, whole_text

# Pre-tokens whose ids a Python worker remembers.
REMEMBERED = 300_000

_BYTE_TO_CHAR = {b: chr(0x100 + b) for b in range(256)}


def read_ranks(path: str) -> bytes:
    """The rank file as it is: lines of a base64 token and its rank."""
    return Path(path).read_bytes()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {
        base64.b64decode(token): int(rank)
        for token, rank in (line.split() for line in data.splitlines() if line.strip())
    }


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, varint or 32-bit float by the type of the value."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_BYTE_TO_CHAR)


# Fixed values of the model format: piece types, model type, field numbers.
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is tokens[i]; the unknown piece comes last."""
    pieces = [
        _field(1, _field(1, mapped(t).encode()) + _field(2, float(-i)) + _field(3, _NORMAL))
        for i, t in enumerate(tokens)
    ]
    n = len(tokens)
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)))
    none = (1 << 64) - 1  # -1 as a varint: no such piece
    trainer = _field(3, _BPE) + _field(4, n + 1) + _field(40, n)
    trainer += _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        tokens = sorted(ranks, key=ranks.__getitem__)
        self._ids = np.array([ranks[t] for t in tokens], "<u4")
        self._whole = {t: struct.pack("<I", r) for t, r in ranks.items()}
        self._bytes = {r: t for t, r in ranks.items()}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self._split = regex.compile(pattern).findall
        self._seen: dict[str, bytes] = {}

    def _merge(self, pre_token: str) -> bytes:
        data = pre_token.encode()
        packed = self._whole.get(data)
        if packed is None:
            packed = self._ids[self._model.encode(mapped(data), out_type=int)].tobytes()
        if len(pre_token) <= 64:
            if len(self._seen) >= REMEMBERED:
                self._seen.clear()
            self._seen[pre_token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        seen, out = self._seen, []
        for p in self._split(text):
            packed = seen.get(p)
            out.append(self._merge(p) if packed is None else packed)
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """The codec of a rank file's content, made once in a Python worker."""
    return Codec(parse_ranks(ranks), pattern)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids binary): the packed ids of every whole text.

    ``ranks`` is the content of a rank file, of fixed size whatever the data;
    it travels to the executors, which need no file of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(shared.value, pattern)
        ids = pa.array([c.encode(t) for t in batch.column(1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = map_slices(rows, run, f"id {type_of(rows, 'id')}, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, id_col="doc_id") -> DataFrame:
    """(id, ids, decoded binary): the bytes that the packed ids stand for; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(shared.value, pattern)
        out = pa.array([c.decode(p) for p in batch.column(1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["id", "ids", "decoded"])

    rows = encoded.select(
        F.col(id_col).alias("id"), F.coalesce("ids", F.lit(b"")).alias("ids")
    )
    out = map_slices(rows, run, f"id {type_of(rows, 'id')}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)
