"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Texts are their UTF-8 bytes, one after the other by id.  A string of
``threshold`` bytes is repeated where it also starts earlier; every byte covered
by a repeated string is removed, judged on the input.

Suffixes are ordered only through the threshold, by passes over digits, the most
significant first, and leave the sort as soon as they are alone:

1. The first digit is a run of K bytes.  Of the suffixes that a string of the
   threshold can be found by, only those at a local minimum of the runs' hashes
   are sorted: which run is least in a string depends on the string alone, so
   equal strings are found by equal runs.  Runs are dealt to buckets by the
   most significant bits of a second hash, as the least first ones are all near 0; a run that occurs once is done.
2. The second digit is the whole surrounding that a string with this run can
   reach.  Of suffixes equal in it, all but the earliest are repeats throughout.
3. What is left, one suffix for each different surrounding of a run, is ordered
   by its content: digits of 8 bytes of the text itself, from the run on and from
   the run backwards, most significant first; what is alone leaves after each
   pass.  A string around a run is the equal bytes before it and after it, so its
   groups follow from the two orders.  They are exactly the repeated strings, byte
   for byte; the earliest stays.

Hashes choose suffixes, deal them to tasks and drop runs that occur once.  Two
things are taken as equal by their hashes, two of 64 bits together: the whole
surroundings of step 2, and strings around the hot runs below.
Copies are combined before every shuffle: within a task only the earliest of
equal surroundings is sent on, so a group of copies counts once for each task.
Runs with more than ``HOT`` different surroundings take another way, in which
all strings are grouped by Spark's own aggregation and join; none is left out.

Defined results: null counts as empty; texts shorter than the threshold stay;
texts of any length are read whole, in blocks.  Rows that share an id are ordered
by 128 bits of their text's SHA-256; equal rows count as one after the other, so all but
one are removed whole; null ids come first.  An empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prsignal.llm.common import give_back, kept, map_slices, tie_of, whole_text

THRESHOLD = 100

# Buckets for each shuffle partition; a task orders one at a time.
BUCKETS = 4

# Different surroundings of a run above which its strings are grouped by Spark itself.
HOT = 20_000

# Bytes of text that are searched, and surroundings that are compared, at a time.
BLOCK, SCANNED, COMPARED = 1 << 17, 4 << 20, 1 << 13

_NO_ID = -(1 << 63)
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_length(threshold: int) -> int:
    return max(1, threshold * 3 // 8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_power = _powers(_BASE, BLOCK + 4096)
_unpower = _powers(_INVERSE, BLOCK + 4096)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding(x: np.ndarray, width: int, least_or_most) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, by doubling."""
    reach = 1
    while reach * 2 <= width:
        x = least_or_most(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return least_or_most(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, threshold: int) -> list[np.ndarray]:
    """(position, hash of the run, hash of the surrounding) of the sorted suffixes of one text."""
    k = run_length(threshold)
    width, n = threshold - k + 1, len(data)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for start in range(0, n - threshold + 1, BLOCK):
        end = min(start + BLOCK, n - threshold + 1)  # of the strings that start in this block
        low, high = max(0, start - width + 1), min(n, end + threshold + width)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[data[low:high]] * _power[: high - low], out=sums[1:])
        first, last = start - low, end - low + width - 1  # of the runs in these strings
        runs = mixed((sums[first + k : last + k] - sums[first:last]) * _unpower[first:last])
        least = sliding(runs, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum) == runs)
        position = at + start
        left = np.minimum(position, width - 1)
        right = np.minimum(n - k - position, width - 1)
        a, b = position - left - low, position + k + right - low
        around = (sums[b] - sums[a]) * _unpower[a]
        around = mixed(around + (left * 65537 + right).astype(np.uint64) * np.uint64(_ODD))
        # The least hashes are all small numbers; mixed again, they are dealt evenly and equal runs stay equal.
        found.append((position, mixed(runs[at] ^ np.uint64(_ODD)), around))
    return [np.concatenate(x) for x in zip(*found)]


def _bytewise(x: np.ndarray) -> bytes:
    """The bytes of equal significance together, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_bytewise(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).ravel()


def packed(run: np.ndarray, around: np.ndarray, doc: np.ndarray, at: np.ndarray, ids, ties) -> bytes:
    """Suffixes in the order of their runs, as one compressed block with the documents they are of."""
    used, doc = np.unique(doc, return_inverse=True)
    parts = [
        struct.pack("<qq", len(run), len(used)),
        ids[used].astype("<i8").tobytes(),
        ties[used].astype("S32").tobytes(),
        _bytewise(np.diff(run, prepend=np.uint64(0)).astype("<u8")),
        around.astype("<u8").tobytes(),
        _bytewise(doc.astype("<u4")),
        _bytewise(at.astype("<i8")),
    ]
    return zstandard.compress(b"".join(parts), 1)


def unpacked(block: bytes) -> list[np.ndarray]:
    """(run, around, document, position) of suffixes, and (id, tie) of documents."""
    data = memoryview(zstandard.decompress(block))
    n, n_docs = struct.unpack("<qq", data[:16])
    at = 16

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return data[at - size : at]

    ids, ties = np.frombuffer(take(8 * n_docs), "<i8"), np.frombuffer(take(32 * n_docs), "S32")
    run = np.cumsum(_from_bytewise(take(8 * n), "<u8", n), dtype=np.uint64)
    around = np.frombuffer(take(8 * n), "<u8")
    doc = _from_bytewise(take(4 * n), "<u4", n)
    return [run, around, doc, _from_bytewise(take(8 * n), "<i8", n), ids, ties]


def _earliest(run, around, ids, ties, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes; which of them come first with their surrounding; which are later ones."""
    order = np.lexsort((at, ties, ids, around, run))
    differs = lambda *columns: np.logical_or.reduce(
        [np.r_[True, (x := c[order])[1:] != x[:-1]] for c in columns]
    )
    first = differs(run, around)
    return order, first, differs(run, around, ids, ties, at) & ~first


_FOUND = pa.schema(
    [
        ("id", pa.int64()),
        ("tie", pa.string()),
        ("lo", pa.int64()),
        ("hi", pa.int64()),
        ("run", pa.int64()),
        ("n", pa.int64()),
        ("bucket", pa.int32()),
        ("block", pa.binary()),
    ]
)
_FOUND_SQL = "id long, tie string, lo long, hi long, run long, n long, bucket int, block binary"


def _hex(ties: np.ndarray) -> pa.Array:
    return pa.array(ties.tolist(), pa.binary()).cast(pa.string())


def _found(**columns) -> pa.RecordBatch:
    n = max(map(len, columns.values()))
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND)


def _scan(threshold: int, n_buckets: int):
    """Texts to packed suffixes by bucket, and the spans that are repeats of suffixes in the same task."""
    reach = threshold - run_length(threshold)

    def search(rows: list[tuple[int, str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        ids, ties = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], "S32")
        rank = np.unique(ties, return_inverse=True)[1]
        got = [anchors(r[2], threshold) for r in rows]
        doc = np.repeat(np.arange(len(rows)), [len(g[0]) for g in got])
        at, run, around = (np.concatenate(x) for x in zip(*got))
        sizes = np.array([len(r[2]) for r in rows])
        order, first, later = _earliest(run, around, ids[doc], rank[doc], at)
        again = order[later]
        if len(again):
            again = again[np.lexsort((at[again], doc[again]))]
            lo = np.maximum(at[again] - reach, 0)
            hi = np.minimum(at[again] + threshold, sizes[doc[again]])
            # Spans that touch are one; within a document both ends ascend.
            start = np.flatnonzero(np.r_[True, (doc[again][1:] != doc[again][:-1]) | (lo[1:] > hi[:-1])])
            d = doc[again][start]
            bucket = (ids[d] % n_buckets).astype(np.int32)
            yield _found(
                id=ids[d], tie=_hex(ties[d]), lo=lo[start], hi=hi[np.append(start[1:], len(hi)) - 1], bucket=bucket
            )
        sent = order[first]
        edges = [-(-(b << 64) // n_buckets) for b in range(1, n_buckets)]
        cuts = np.searchsorted(run[sent], np.array(edges, np.uint64))
        for b, part in enumerate(np.split(sent, cuts)):
            if len(part):
                block = packed(run[part], around[part], doc[part], at[part], ids, ties)
                yield _found(bucket=[b], block=[block])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            texts = batch.column(2)
            for i, (doc, tie) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                if len(data) >= threshold:
                    rows.append((doc, tie, data))
                    size += len(data)
                if size >= SCANNED:
                    yield from search(rows)
                    rows, size = [], 0
        yield from search(rows)
        give_back()

    return scan


def _sort(threshold: int):
    """Buckets of suffixes to repeated spans, and to suffixes (lo: position) whose strings are to be compared."""
    reach = threshold - run_length(threshold)

    def ordered(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        got = list(map(unpacked, blocks))
        run, around, at = (np.concatenate([g[k] for g in got]) for k in (0, 1, 3))
        offsets = np.cumsum([0, *(len(g[4]) for g in got[:-1])])
        doc = np.concatenate([g[2] + offset for g, offset in zip(got, offsets)])
        names, rank = np.unique(np.concatenate([g[5] for g in got]), return_inverse=True)
        ids, ties = np.concatenate([g[4] for g in got])[doc], rank[doc]
        order, first, later = _earliest(run, around, ids, ties, at)
        i = order[later]
        if len(i):
            # The text may end before hi; spans are cut to it where they are applied.
            yield _found(id=ids[i], tie=_hex(names[ties[i]]), lo=np.maximum(at[i] - reach, 0), hi=at[i] + threshold)
        i = order[first]
        starts = np.flatnonzero(np.r_[True, run[i][1:] != run[i][:-1]])
        sizes = np.diff(np.append(starts, len(i)))
        n = np.repeat(sizes, sizes)
        i, n = i[n > 1], n[n > 1]
        if len(i):
            yield _found(id=ids[i], tie=_hex(names[ties[i]]), lo=at[i], run=run[i].view(np.int64), n=n)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks = None, []
        for batch in batches:
            spans = batch.filter(pc.is_null(batch.column("block")))
            if spans.num_rows:
                yield spans
            batch = batch.filter(pc.is_valid(batch.column("block")))
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if bucket != current and blocks:
                    yield from ordered(blocks)
                    blocks = []
                current = bucket
                blocks.append(block)
        if blocks:
            yield from ordered(blocks)
        give_back()

    return sort


def _string_hashes(around: np.ndarray, threshold: int) -> np.ndarray:
    """Hashes of all strings of the threshold in each row of bytes."""
    n, width = around.shape
    sums = np.zeros((n, width + 1), np.uint64)
    np.cumsum(_BYTES[around] * _power[:width], axis=1, out=sums[:, 1:])
    starts = width - threshold + 1
    return mixed((sums[:, threshold:] - sums[:, :starts]) * _unpower[:starts])


def _surroundings(batch: pa.RecordBatch, threshold: int):
    """(row, position, left reach, surrounding padded to its full width, validity of each string) of requests."""
    k = run_length(threshold)
    reach = threshold - k
    width = threshold + reach
    for row, (text, positions) in enumerate(zip(batch.column("text"), batch.column("at").to_pylist())):
        data = np.frombuffer(text.as_buffer(), np.uint8)
        at = np.array(positions, np.int64)
        padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(reach + 1, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
        starts = at[:, None] - reach + np.arange(reach + 1)
        yield row, at, around, (starts >= 0) & (starts + threshold <= len(data))


def _contexts(threshold: int):
    """Requested suffixes with their surroundings: (run, id, tie, at, valid from, valid to, around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(0, batch.num_rows, 256):
                part = batch.slice(at_row, 256)
                out = []
                ids, ties, runs = (part.column(c).to_pylist() for c in ("id", "tie", "run"))
                for row, at, around, valid in _surroundings(part, threshold):
                    first, last = valid.argmax(1), valid.shape[1] - valid[:, ::-1].argmax(1)
                    out += zip(
                        runs[row], [ids[row]] * len(at), [ties[row]] * len(at), at.tolist(), first.tolist(),
                        last.tolist(), map(bytes, around),
                    )
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    names = ["run", "id", "tie", "at", "first", "last", "around"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return run, "run long, id long, tie string, at long, first int, last int, around binary"


_SPAN = "id long, tie string, lo long, hi long"


def content_order(groups: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Rows of bytes in their order within groups that lie together: most significant digits of 8 bytes first.

    After every pass, rows that are alone with their digits leave the sort.
    """
    n, width = content.shape
    digits = np.zeros((n, -(-width // 8) * 8), np.uint8)
    digits[:, :width] = content
    digits = digits.view(">u8")
    order = np.arange(n)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    group = np.repeat(starts, np.diff(np.append(starts, n)))
    for digit in digits.T:
        active = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1)
        if not len(active):
            break
        mine, rows = group[active], order[active]
        value = digit[rows].astype(np.uint64)
        by = np.lexsort((value, mine))
        order[active], value = rows[by], value[by]
        new = np.r_[True, (mine[1:] != mine[:-1]) | (value[1:] != value[:-1])]
        group[active] = active[new][np.cumsum(new) - 1]
    return order


def classes(groups: np.ndarray, content: np.ndarray) -> np.ndarray:
    """[row, depth]: numbers that are equal where rows of a group have that many equal first bytes."""
    n, width = content.shape
    order = content_order(groups, content)
    ordered = content[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common[groups[order][1:] != groups[order][:-1]] = -1
    out = np.zeros((n, width + 1), np.int64)
    out[order[1:]] = np.cumsum(common[:, None] < np.arange(width + 1), axis=0)
    return out


def _compare(threshold: int):
    """Surroundings in the order of run, id, tie and position, to the spans of repeated strings."""
    reach = threshold - run_length(threshold)

    def spans(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        run, ids, at, first, last = (rows.column(c).to_numpy() for c in ("run", "id", "at", "first", "last"))
        ties = rows.column("tie").combine_chunks()
        around = np.frombuffer(b"".join(rows.column("around").to_pylist()), np.uint8).reshape(n, -1)
        # A string that starts at a place has the bytes from there to the run, backwards, and those from the run on.
        before = classes(run, around[:, :reach][:, ::-1])
        after = classes(run, around[:, reach:])
        place = np.arange(reach + 1)
        row, place = np.nonzero((place >= first[:, None]) & (place < last[:, None]))
        key = (place * n + before[row, reach - place]) * n + after[row, threshold - reach + place]
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = np.r_[False, k[1:] == k[:-1]] if len(k) else np.zeros(0, bool)
        repeated = np.sort(order[again])  # by row, then by place
        row, lo = row[repeated], (at[row] - reach + place)[repeated]
        begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (lo[1:] != lo[:-1] + 1)]) if len(row) else []
        begins = np.array(begins, np.int64)
        ends = np.append(begins[1:], len(row)) - 1 if len(row) else begins
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[row[begins]], pa.int64()),
                ties.take(pa.array(row[begins], pa.int64())),
                pa.array(lo[begins], pa.int64()),
                pa.array(lo[ends] + threshold, pa.int64()),
            ],
            ["id", "tie", "lo", "hi"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if rows.num_rows < COMPARED:
                held = rows
                continue
            run = rows.column("run").to_numpy()
            whole = int(np.searchsorted(run, run[-1]))  # the last run may go on
            if whole:
                yield spans(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None and held.num_rows:
            yield spans(held)
        give_back()

    return compare


def _strings(threshold: int):
    """Requested suffixes to every string around them: (key, key2, id, tie, lo)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], [], [], []]
        ids, ties, runs = (batch.column(c).to_pylist() for c in ("id", "tie", "run"))
        reach = threshold - run_length(threshold)
        for row, at, around, valid in _surroundings(batch, threshold):
            r, p = np.nonzero(valid)
            out[0].append(_string_hashes(around, threshold)[r, p].view(np.int64))
            out[1].append(np.array(runs[row], np.int64)[r])
            out[2].append(np.full(len(r), ids[row]))
            out[3].append(np.full(len(r), ties[row], "U32"))
            out[4].append(at[r] - reach + p)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        columns = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, types)]
        return pa.RecordBatch.from_arrays(columns, ["key", "key2", "id", "tie", "lo"])

    return run, "key long, key2 long, id long, tie string, lo long"


def _apply(threshold: int, whole_characters: bool):
    """Texts with their repeated spans, to what is left of them."""

    def merged(spans: list[dict], n: int) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for lo, hi in sorted((s["lo"], min(s["hi"], n)) for s in spans):
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return [(lo, hi) for lo, hi in out]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, left = [], [], []
        for text, copy, spans in zip(
            batch.column("text"), batch.column("copy").to_pylist(), batch.column("spans").to_pylist()
        ):
            data = text.as_buffer().to_pybytes()
            n = len(data)
            if copy > 1:
                cut = [(0, n)] if n >= threshold else []
            else:
                cut = merged(spans or [], n)
            if whole_characters:
                inside = lambda i: i < n and data[i] & 0xC0 == 0x80
                shrunk = []
                for lo, hi in cut:
                    while inside(lo):
                        lo += 1
                    while inside(hi):
                        hi -= 1
                    shrunk.append((lo, hi))
                cut = [s for s in shrunk if s[0] < s[1]]
            edges = [0, *(x for s in cut for x in s), n]
            sizes.append(n)
            removed.append([{"lo": lo, "hi": hi} for lo, hi in cut])
            left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        spans_type = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("rest"), pa.array(sizes, pa.int64()), pa.array(removed, spans_type), pa.array(left, pa.binary())],
            ["rest", "n_bytes", "spans", "left"],
        )

    return run


def without_repeats(
    docs: DataFrame, threshold: int = THRESHOLD, whole_characters: bool = False, id_col="doc_id", text_col="text",
    hot: int = HOT,
) -> DataFrame:
    """(rest struct, n_bytes, spans array<struct<lo, hi>>, left binary): what is left of every text.

    ``rest`` has all columns but the text.  ``whole_characters`` keeps the bytes
    of characters that a span covers only in part.
    """
    spark = docs.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = BUCKETS * n_tasks
    text = whole_text(text_col)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
        tie_of(text).alias("tie"),
        text.alias("text"),
        rest.alias("rest"),
    )
    found = kept(
        rows.select("id", "tie", "text")
        .mapInArrow(_scan(threshold, n_buckets), _FOUND_SQL)
        .repartition(n_tasks, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_sort(threshold), _FOUND_SQL)
    )
    spans = found.where("run IS NULL").select("id", "tie", "lo", "hi")
    asked = found.where("run IS NOT NULL").select("id", "tie", F.col("lo").alias("at"), "run", "n")

    # Texts move once: both joins below use this partitioning.
    one_of_equals = F.row_number().over(Window.partitionBy("id", "tie").orderBy("id"))
    placed = rows.repartition(n_tasks, "id", "tie").withColumn("copy", one_of_equals)

    def with_texts(requests: DataFrame) -> DataFrame:
        by_doc = requests.groupBy("id", "tie").agg(
            F.collect_list(F.struct("at", "run")).alias("asked")  # as many as the text has suffixes
        )
        # With ``rest``, though it isn't needed here: the exchange of the texts is then the same as below.
        return placed.where("copy = 1").join(by_doc, ["id", "tie"]).select(
            "id", "tie", "text", F.col("asked")["at"].alias("at"), F.col("asked")["run"].alias("run"), "rest"
        )

    context, schema = _contexts(threshold)
    compared = (
        with_texts(asked.where(F.col("n") <= hot))
        .mapInArrow(context, schema)
        .repartition(n_tasks, "run")
        .sortWithinPartitions("run", "id", "tie", "at")
        .mapInArrow(_compare(threshold), _SPAN)
    )
    spans = spans.unionByName(compared)
    often = asked.where(F.col("n") > hot)
    if not often.isEmpty():
        string, schema = _strings(threshold)
        strings = map_slices(with_texts(often), string, schema, rows=64)
        earliest = strings.groupBy("key", "key2").agg(F.min(F.struct("id", "tie", "lo")).alias("earliest"))
        again = strings.join(earliest, ["key", "key2"]).where(F.struct("id", "tie", "lo") > F.col("earliest"))
        spans = spans.unionByName(again.select("id", "tie", "lo", (F.col("lo") + threshold).alias("hi")))

    by_doc = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = placed.join(by_doc, ["id", "tie"], "left").select("rest", "text", "copy", "spans")
    rest_type = joined.schema["rest"].dataType.simpleString()
    return map_slices(
        joined,
        _apply(threshold, whole_characters),
        f"rest {rest_type}, n_bytes long, spans array<struct<lo: long, hi: long>>, left binary",
    )
