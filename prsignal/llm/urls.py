"""Url rules in a sorted digest array.

An index holds the 64-bit xxhash keys of all rule strings in ascending order,
and the strings themselves beside them.  It is one file, which Spark copies to
every executor once and every Python worker maps into its memory, so that the
workers of a machine share its pages.  A url is looked up by all strings that a
rule fitting it could have (its host and every parent domain, followed by its
path cut at the lengths that occur in rules): vectorised binary search finds the
keys, and a hit counts only if the stored string is the same in full.

Rules are pairs (string ``host/path``, verdict).  A rule fits its host and all
subdomains if the path of the url starts with the path of the rule, which
begins with the slash.  The longest fitting string wins; of equally long ones
the one with the longer host.  Without a fitting rule nothing is found, and the
url is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path
and is allowed; only A-Z is lower-cased; equal urls get equal results; of equal
rule strings with different verdicts ``block`` wins; no rules, or no urls, give
no hits and no rows.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.llm.common import map_slices, type_of

# Bytes of a rule list; a larger one is refused instead of being sent to every executor.
MAX_INDEX_BYTES = 1 << 30

VERDICTS = ("allow", "block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def index_bytes(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file of an index: counts, keys, offsets, verdicts, path lengths, strings."""
    verdict_of: dict[str, str] = {}
    for rule, verdict in rules:
        if verdict not in VERDICTS or "/" not in rule:
            raise ValueError(f"not a rule: {rule!r} {verdict!r}")
        verdict_of[rule] = max(verdict, verdict_of.get(rule, verdict))
    digest = {r: xxhash.xxh64_intdigest(r.encode()) for r in verdict_of}
    order = sorted(verdict_of, key=lambda r: (digest[r], r))
    texts = [r.encode() for r in order]
    lengths = sorted({len(r) - r.index("/") for r in order})
    data = b"".join(
        [
            struct.pack("<qq", len(order), len(lengths)),
            np.array([digest[r] for r in order], "<u8").tobytes(),
            np.cumsum([0, *map(len, texts)], dtype="<i8").tobytes(),
            np.array(lengths, "<i8").tobytes(),
            np.array([VERDICTS.index(verdict_of[r]) for r in order], "u1").tobytes(),
            *texts,
        ]
    )
    if len(data) > MAX_INDEX_BYTES:
        raise ValueError(f"the rules take {len(data)} bytes, over {MAX_INDEX_BYTES}")
    return data


def publish(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Give the index of these rules to all executors; returns its name there."""
    name = f"rules-{uuid.uuid4().hex}"
    # The driver serves the file from the folder that Spark keeps for files of a session.
    folder = os.path.join(SparkFiles.getRootDirectory(), f"source-{name}")
    os.makedirs(folder)
    with open(os.path.join(folder, name), "wb") as out:
        out.write(index_bytes(rules))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


class Index:
    """A memory-mapped rule index."""

    def __init__(self, path: str):
        raw = np.memmap(path, "u1", "r")
        n, n_lengths = struct.unpack("<qq", raw[:16].tobytes())
        at = 16
        self.keys = raw[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view("<i8")
        at += 8 * (n + 1)
        self.lengths = raw[at : at + 8 * n_lengths].view("<i8").tolist()
        at += 8 * n_lengths
        self.verdicts = raw[at : at + n]
        self.texts = raw[at + n :]

    def find(self, strings: list[str]) -> np.ndarray:
        """The position of each string in the index, -1 if it isn't there."""
        out = np.full(len(strings), -1, np.int64)
        if not len(self.keys) or not strings:
            return out
        data = [s.encode() for s in strings]
        keys = np.array([xxhash.xxh64_intdigest(d) for d in data], np.uint64)
        first = np.searchsorted(self.keys, keys, "left")
        last = np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(first < last):
            for k in range(first[i], last[i]):  # more than one only when keys collide
                if self.texts[self.offsets[k] : self.offsets[k + 1]].tobytes() == data[i]:
                    out[i] = k
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        """(rule, verdict) of each url."""
        strings: dict[str, int] = {}
        asked: list[list[tuple[str, int]]] = []
        for host, path in zip(hosts, paths):
            cuts = [n for n in self.lengths if n <= len(path)]
            mine, domain = [], host
            while domain:
                mine += [(s, len(domain)) for n in cuts if (s := domain + path[:n])]
                _, dot, domain = domain.partition(".")
                if not dot:
                    break
            for s, _ in mine:
                strings.setdefault(s, len(strings))
            asked.append(mine)
        found = self.find(list(strings))
        out = []
        for mine in asked:
            hits = [(len(s), n, s) for s, n in mine if found[strings[s]] >= 0]
            if hits:
                _, _, s = max(hits)
                out.append((s, VERDICTS[self.verdicts[found[strings[s]]]]))
            else:
                out.append((None, "allow"))
        return out


@functools.lru_cache(maxsize=4)
def opened(name: str) -> Index:
    return Index(SparkFiles.get(name))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col="page_id", url_col="url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    name = publish(pages.sparkSession, rules)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths = batch.column(1), batch.column(2)
        got = opened(name).judge(hosts.to_pylist(), paths.to_pylist())
        rule = pa.array([r for r, _ in got], pa.string())
        verdict = pa.array([v for _, v in got], pa.string())
        strings = [pc.cast(c, pa.string()) for c in (hosts, paths)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *strings, rule, verdict], ["id", "host", "path", "rule", "verdict"]
        )

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    out = map_slices(
        rows, run, f"id {type_of(rows, 'id')}, host string, path string, rule string, verdict string", rows=4096
    )
    return out.withColumnRenamed("id", id_col)
