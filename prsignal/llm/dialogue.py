"""Repair of the role order of conversations, by divide and conquer in linear space.

A conversation is right when its roles are ``(system? (user assistant)+)?``,
told by their initials.  Rows are kept (0), given another role (1), deleted (2),
or empty rows are inserted (5); blank rows and copies of earlier rows have to
go, and a row whose text breaks off costs 5 more unless it is deleted.  Of the
cheapest repairs the one whose edits, written as initials in order, come first
in ASCII is taken.

The order is a machine of four states, so the cost of all ways to repair the
first rows fits in a vector of four, and so does the cost of all ways to repair
the rows that follow.  Hirschberg's method lets the two meet in the middle of a
conversation, chooses the state to cross in, and goes on in both halves; nothing
but one vector each way is ever held.  Ties are settled without comparing texts:
insertions always go before the row that follows, so the edits of two different
ways through the same rows never begin with one another, and a rank of the
four states says which has the lesser edits.

A conversation of any length is dealt over tasks: rows are sorted by range,
tasks cut them into blocks, give the cost of each block from every state to
every state, and only these are put together in order (one row for ``BLOCK``
rows).  Blocks are then repaired apart, between the states they were given.
Texts move once, in the order of the rows, next to the edits.  Rows of one
conversation pass through one task there, one at a time, as its text and the
digest of it have to be written in order; they are not held.

Defined results: a null conversation, role or text counts as one space, a null
turn comes first; rows of one turn are taken in the order of a digest of role and
text; repeated rows are copies of each other; a role that begins with none of s, u
and a can only be changed or deleted; texts of any length are read whole; other
columns are not looked at; an empty table gives an empty table; a conversation
whose rows are all gone stays in the result with no edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prsignal.llm.common import kept

# White space, and the marks a text may end with.
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5

# Codes of rows: an initial, and four times a fault.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# Which initials may follow one another.
_FOLLOWS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

# States: nothing yet, after system, after user, after assistant.
STATES = range(4)
START = 0
_NEXT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}
# The role that a state asks for, where rows are changed or inserted.
_WANTED = {0: USER, 1: USER, 2: ASSISTANT, 3: USER}
# Insertions that end a conversation right.
_LAST_INSERTIONS = {0: "", 1: INSERT * 2, 2: INSERT, 3: ""}

# Rows of a conversation that are repaired as one.
BLOCK = 4096
# Output that Python hands over at once.
BATCH_BYTES = 1 << 20

_FAR = 1 << 60


# -- the machine -----------------------------------------------------------


def _steps(code: int) -> list[list[tuple[int, str] | None]]:
    """``[from][to]``: cost and edits of the cheapest, least way to deal with one row."""
    initial, fault = code % 4, code // 4
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    for start in STATES:
        state = start
        for n in range(3):
            ways = [(DELETE, state, 0)]
            if fault not in (BLANK, DUPLICATE):
                if (state, initial) in _NEXT:
                    ways.append((KEEP, _NEXT[state, initial], extra))
                if initial != _WANTED[state]:
                    ways.append((REROLE, _NEXT[state, _WANTED[state]], extra))
            for edit, to, more in ways:
                way = (n * COST[INSERT] + COST[edit] + more, INSERT * n + edit)
                if table[start][to] is None or way < table[start][to]:
                    table[start][to] = way
            state = _NEXT[state, _WANTED[state]]
    return table


_STEPS = [_steps(code) for code in range(16)]
# The edits of one row in ASCII order.
_EDITS = sorted({way[1] for table in _STEPS for ways in table for way in ways if way})
_WAYS = [
    [
        (start, to, way[0], _EDITS.index(way[1]))
        for start, ways in enumerate(table)
        for to, way in enumerate(ways)
        if way
    ]
    for table in _STEPS
]

Vector = tuple[list[int], list[int]]


def _ranked(best: list[tuple[int, int] | None]) -> Vector:
    """(costs, ranks) of (cost, key) for each state; equal keys can't be."""
    keys = sorted(b[1] for b in best if b)
    return [b[0] if b else _FAR for b in best], [keys.index(b[1]) if b else 0 for b in best]


def _forward(codes: bytes, start: int) -> Vector:
    """Costs of all ways through the rows from ``start`` to each state, and the ranks of their least edits."""
    costs, ranks = [0 if s == start else _FAR for s in STATES], [0] * 4
    for code in codes:
        best: list[tuple[int, int] | None] = [None] * 4
        for before, to, cost, edits in _WAYS[code]:
            if costs[before] < _FAR:
                way = (costs[before] + cost, ranks[before] * len(_EDITS) + edits)
                if best[to] is None or way < best[to]:
                    best[to] = way
        costs, ranks = _ranked(best)
    return costs, ranks


def _backward(codes: bytes, end: int) -> list[int]:
    """Costs of all ways through the rows from each state to ``end``."""
    costs = [0 if s == end else _FAR for s in STATES]
    for code in reversed(codes):
        before = [_FAR] * 4
        for start, to, cost, _ in _WAYS[code]:
            before[start] = min(before[start], costs[to] + cost)
        costs = before
    return costs


def _between(codes: bytes, start: int, end: int) -> str:
    """The cheapest, least edits of rows that lead from one state to another."""
    done: list[str] = []
    waiting = [(0, len(codes), start, end)]
    while waiting:
        low, high, start, end = waiting.pop()
        if high - low == 1:
            done.append(_STEPS[codes[low]][start][end][1])
        elif high > low:
            middle = (low + high) // 2
            costs, ranks = _forward(codes[low:middle], start)
            after = _backward(codes[middle:high], end)
            cross = min(STATES, key=lambda s: (costs[s] + after[s], ranks[s]))
            waiting += [(middle, high, cross, end), (low, middle, start, cross)]
    return "".join(done)


def _last(costs: list[int], ranks: list[int]) -> tuple[int, int]:
    """(cost, state) of the cheapest, least end, with the insertions that are still needed."""
    insertions = [len(_LAST_INSERTIONS[s]) * COST[INSERT] for s in STATES]
    state = min(STATES, key=lambda s: (costs[s] + insertions[s], ranks[s]))
    return costs[state] + insertions[state], state


@lru_cache(maxsize=1 << 16)
def repair(codes: bytes) -> tuple[int, str]:
    """(cost, edits) of a whole conversation, given the codes of its rows."""
    cost, end = _last(*_forward(codes, START))
    return cost, _between(codes, START, end) + _LAST_INSERTIONS[end]


# -- rows ------------------------------------------------------------------


def _conversation(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def turns(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv, turn, role, text, copies, same, initial, blank, open) of rows (conv_id, turn, role, text).

    ``copies`` says how often a row stands; 0 leaves only its conversation.
    """
    first, text = F.substring("role", 1, 1), F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    return (
        rows.select(
            _conversation("conv_id").alias("conv"),
            "turn",
            F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"),
            (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
        )
        .withColumn("same", F.substring(F.sha2(F.concat(F.sha2("role", 256), "text"), 256), 1, 32))
        .withColumn("initial", initial)
        .withColumn("blank", text == "")
        .withColumn("open", ~F.substring(text, -1, 1).isin(*ENDS))
    )


def _codes(rows: DataFrame) -> DataFrame:
    """(conv, turn, same, code, copies, again): equal rows once, without text; ``again`` if an earlier turn has it."""
    fault = F.when(F.col("blank"), BLANK).when(F.col("open"), TRUNCATED).otherwise(FINE)
    once = kept(
        rows.groupBy("conv", "turn", "same", (F.col("initial") + 4 * fault).alias("code")).agg(
            F.sum("copies").alias("copies")
        )
    )
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = once.where("copies > 0").groupBy("conv", "same").agg(F.min(at).alias("first"))
    again = F.coalesce(F.col("first") < at, F.lit(False))
    return once.join(first, ["conv", "same"], "left").select("conv", "turn", "same", "code", "copies", again.alias("again"))


def _with_copies(codes: np.ndarray, copies: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Codes of all copies: the first as it is, unless it was seen before, the others as duplicates."""
    blank = codes // 4 == BLANK
    as_copy = np.where(blank, codes, codes % 4 + 4 * DUPLICATE)
    out = np.repeat(as_copy, copies)
    there = copies > 0
    firsts = np.concatenate([[0], np.cumsum(copies)[:-1]])[there] if len(codes) else np.zeros(0, int)
    out[firsts.astype(int)] = np.where(again, as_copy, codes)[there]
    return out.astype(np.uint8)


_FACTS = "blank long, duplicate long, truncated long, illegal long, first long, last long, n_turns long"
_BLOCK = f"conv string, part int, block int, whole boolean, codes binary, cost long, audit string, ways binary, {_FACTS}"


def _facts(codes: bytes) -> list[int]:
    """Numbers of blank, duplicate and truncated rows and of wrong neighbours."""
    faults = [c // 4 for c in codes]
    wrong = sum((a % 4, b % 4) not in _FOLLOWS for a, b in zip(codes, codes[1:]))
    return [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), wrong]


_cached_facts = lru_cache(maxsize=1 << 16)(_facts)


def _ways(codes: bytes) -> bytes:
    """Costs and ranks from every state to every state, as 32 numbers."""
    return np.array([_forward(codes, s) for s in STATES], np.int64).tobytes()


def _blocks(part: int, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_BLOCK`` from sorted rows of codes.

    A conversation that lies wholly within the task and one block of ``most``
    rows is repaired at once; for others the costs between all states are given.
    """
    out: list[tuple] = []

    def add(conv, number, codes, seen, whole):
        codes = bytes(codes)
        facts = (_cached_facts if len(codes) <= 64 else _facts)(codes)
        cost, audit = (repair if len(codes) <= 64 else repair.__wrapped__)(codes) if whole else (None, None)
        ways = None if whole else _ways(codes)
        out.append((conv, part, number, whole, codes, cost, audit, ways, *facts, *seen))

    def batch():
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        types = [
            pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.binary(),
            *[pa.int64()] * 7,
        ]
        columns = list(zip(*out)) if out else [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    conv, number, codes, alone = None, 0, bytearray(), False
    first = last = None
    n_turns = 0

    def close(whole):
        nonlocal number, codes, first, n_turns
        add(conv, number, codes[:most], (first, last, n_turns), whole)
        number, codes, first, n_turns = number + 1, codes[most:], None, 0

    seen_turn = None
    for b in batches:
        convs = b.column("conv").to_pylist()
        turn_of = b.column("turn").to_pylist()
        copies = b.column("copies").to_numpy(zero_copy_only=False)
        rows_codes = b.column("code").to_numpy(zero_copy_only=False).astype(np.int64)
        again = b.column("again").to_numpy(zero_copy_only=False)
        at = 0
        for name, group in groupby(convs):
            size = sum(1 for _ in group)
            if name != conv:
                if conv is not None:
                    # The first conversation of a task may have begun in another one.
                    while len(codes) > most:
                        close(False)
                    close(alone and number == 0)
                alone = conv is not None
                conv, number, codes, first, last, n_turns, seen_turn = name, 0, bytearray(), None, None, 0, None
            for low in range(at, at + size, most):
                high = min(low + most, at + size)
                for i in range(low, high):
                    if copies[i] > 0 and turn_of[i] is not None:
                        if turn_of[i] != seen_turn:
                            n_turns += 1
                            seen_turn = turn_of[i]
                        first = turn_of[i] if first is None else first
                        last = turn_of[i]
                left = copies[low:high].copy()
                if left.sum() <= 4 * most:
                    codes += _with_copies(rows_codes[low:high], left, again[low:high]).tobytes()
                else:
                    # Many copies of single rows: a stretch at a time.
                    for i in range(low, high):
                        code = int(rows_codes[i])
                        as_copy = code if code // 4 == BLANK else code % 4 + 4 * DUPLICATE
                        if left[i - low]:
                            codes.append(as_copy if again[i] else code)
                        rest = max(int(left[i - low]) - 1, 0)
                        while rest:
                            n = min(rest, 4 * most)
                            codes += bytes([as_copy]) * n
                            rest -= n
                            while len(codes) > most:
                                close(False)
                while len(codes) > most:
                    close(False)
                if len(out) >= 1000:
                    yield batch()
            at += size
    if conv is not None:
        # The last conversation of a task may go on in another one.
        close(False)
    yield batch()


def _put_together(batches) -> Iterator[pa.RecordBatch]:
    """States and costs of the blocks of whole conversations, which come in order."""

    def rows():
        for b in batches:
            yield from b.to_pylist()

    for conv, blocks in groupby(rows(), key=lambda r: r["conv"]):
        costs, ranks = [0, _FAR, _FAR, _FAR], [0] * 4
        places, parents, wrong, before = [], [], [], None
        for r in blocks:
            ways = np.frombuffer(r["ways"], np.int64).reshape(4, 2, 4).tolist()
            best: list[tuple[int, int] | None] = [None] * 4
            parent = [0] * 4
            for start in STATES:
                for to in STATES:
                    if costs[start] < _FAR and ways[start][0][to] < _FAR:
                        way = (costs[start] + ways[start][0][to], ranks[start] * 4 + ways[start][1][to])
                        if best[to] is None or way < best[to]:
                            best[to], parent[to] = way, start
            costs, ranks = _ranked(best)
            parents.append(parent)
            places.append((r["part"], r["block"]))
            wrong.append(int(before is not None and r["head"] is not None and (before, r["head"]) not in _FOLLOWS))
            before = before if r["tail"] is None else r["tail"]
        total, state = _last(costs, ranks)
        ends = []
        for parent in reversed(parents):
            ends.append((parent[state], state))
            state = parent[state]
        ends.reverse()
        n = len(places)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([conv] * n, pa.string()),
                pa.array([p for p, _ in places], pa.int32()),
                pa.array([b for _, b in places], pa.int32()),
                pa.array([s for s, _ in ends], pa.int32()),
                pa.array([t for _, t in ends], pa.int32()),
                pa.array([""] * (n - 1) + [_LAST_INSERTIONS[ends[-1][1]]], pa.string()),
                pa.array([0] * (n - 1) + [total], pa.int64()),
                pa.array(wrong, pa.int64()),
            ],
            names=["conv", "part", "block", "start", "end", "more", "total", "wrong"],
        )


def _repair_blocks(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        audits = [
            _between(r["codes"], r["start"], r["end"]) + r["more"]
            for r in b.select(["codes", "start", "end", "more"]).to_pylist()
        ]
        kept_columns = [b.column(c) for c in ("conv", "part", "block", "wrong", "total")]
        yield pa.RecordBatch.from_arrays(
            [*kept_columns, pa.array(audits, pa.string())], names=["conv", "part", "block", "wrong", "total", "audit"]
        )


def edits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, part, block, audit, cost, blank, duplicate, truncated, illegal, first, last, n_turns).

    One row for each block (of at most ``block`` rows) of each conversation of
    :func:`turns`; the audits of a conversation's blocks in order are its edits.
    """

    def blocks(batches):
        return _blocks(TaskContext.get().partitionId(), batches, block)

    ordered = _codes(rows).repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "same")
    found = kept(ordered.select("conv", "turn", "code", "copies", "again").mapInArrow(blocks, _BLOCK))
    facts = ["blank", "duplicate", "truncated", "illegal", "first", "last", "n_turns"]
    apart = found.where("NOT whole")
    code_at = F.when(F.octet_length("codes") > 0, F.conv(F.hex(F.substring("codes", 1, 1)), 16, 10).cast("int") % 4)
    code_end = F.when(F.octet_length("codes") > 0, F.conv(F.hex(F.substring("codes", -1, 1)), 16, 10).cast("int") % 4)
    states = (
        apart.select("conv", "part", "block", "ways", code_at.alias("head"), code_end.alias("tail"))
        .repartition("conv")
        .sortWithinPartitions("conv", "part", "block")
        .mapInArrow(
            _put_together,
            "conv string, part int, block int, start int, end int, more string, total long, wrong long",
        )
    )
    key = ["conv", "part", "block"]
    solved = (
        apart.select(*key, "codes")
        .join(kept(states), key)
        .repartition(*key)
        .mapInArrow(_repair_blocks, "conv string, part int, block int, wrong long, total long, audit string")
    )
    long = apart.select(*key, *facts).join(solved, key).withColumn("illegal", F.col("illegal") + F.col("wrong"))
    columns = [*key, "audit", "cost", *facts]
    return kept(
        found.where("whole")
        .select(*columns)
        .unionByName(long.withColumnRenamed("total", "cost").select(*columns))
    )


def _walk(batches) -> Iterator[pa.RecordBatch]:
    """Rows (conv, place, edit, role, text) of repaired conversations from their edits and then their rows."""
    out: list[tuple] = []
    size = 0

    def batch():
        nonlocal size
        size = 0
        columns = list(zip(*out)) if out else [()] * 5
        out.clear()
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["conv", "place", "edit", "role", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def add(conv, edit, role, text):
        nonlocal place, size
        out.append((conv, place, edit, role, text))
        place += 1
        size += len(text) + 64

    def insertions():
        """Rows that are inserted here."""
        nonlocal at, state
        while at < len(audit) and audit[at : at + 1] == b"I":
            add(conv, INSERT, ROLES[_WANTED[state]], "")
            state = _NEXT[state, _WANTED[state]]
            at += 1

    conv, audit, at, state, place = None, bytearray(), 0, START, 0
    for b in batches:
        names = ("conv", "audit", "role", "text", "copies", "initial")
        for name, piece, role, text, copies, initial in zip(*(b.column(c).to_pylist() for c in names)):
            if name != conv:
                if conv is not None:
                    insertions()
                conv, audit, at, state, place = name, bytearray(), 0, START, 0
            if piece is not None:
                audit += piece.encode()
                continue
            for _ in range(copies):
                insertions()
                edit = chr(audit[at])
                at += 1
                if edit == KEEP:
                    add(conv, KEEP, role, text)
                    state = _NEXT[state, initial]
                elif edit == REROLE:
                    add(conv, REROLE, ROLES[_WANTED[state]], text)
                    state = _NEXT[state, _WANTED[state]]
            if size >= BATCH_BYTES:
                yield batch()
    if conv is not None:
        insertions()
    yield batch()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the rows of repaired conversations.

    ``found`` are the :func:`edits` of ``rows``.  Rows of a conversation follow
    one another in one partition.
    """
    nothing = {"turn": "long", "same": "string", "role": "string", "text": "string", "copies": "long", "initial": "int"}
    nothing["turn"] = rows.schema["turn"].dataType.simpleString()
    audits = found.select(
        "conv", F.lit(0).alias("kind"), "part", "block", "audit",
        *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()],
    )
    texts = rows.where("copies > 0").select(
        "conv", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("part"),
        F.lit(None).cast("int").alias("block"), F.lit(None).cast("string").alias("audit"),
        "turn", "same", "role", F.when(F.col("blank"), "").otherwise(F.col("text")).alias("text"), "copies", "initial",
    )
    return (
        audits.unionByName(texts)
        .repartition("conv")
        .sortWithinPartitions("conv", "kind", "part", "block", "turn", "same")
        .select("conv", "audit", "role", "text", "copies", "initial")
        .mapInArrow(_walk, "conv string, place long, edit string, role string, text string")
    )


def _digest(batches) -> Iterator[pa.RecordBatch]:
    conv, state = None, None

    def result():
        columns = [pa.array([conv], pa.string()), pa.array([state.hexdigest()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "digest"])

    for b in batches:
        for name, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text"))):
            if name != conv:
                if conv is not None:
                    yield result()
                conv, state = name, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
    if conv is not None:
        yield result()


def digests(conversations: DataFrame) -> DataFrame:
    """(conv, digest): SHA-256 of the lines ``role:text`` of :func:`repaired`, read as they come."""
    return conversations.select("conv", "role", "text").mapInArrow(_digest, "conv string, digest string")


def summary(rows: DataFrame, found: DataFrame, conv_type: str = "long") -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, edits and digest."""
    pieces = F.array_sort(F.collect_list(F.struct("part", "block", "audit")))
    whole = found.groupBy("conv").agg(
        F.coalesce(F.max("last") - F.min("first") + 1 - F.sum("n_turns"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
    )
    empty = F.sha2(F.lit(""), 256)
    return whole.join(digests(repaired(rows, found)), "conv", "left").select(
        F.when(F.col("conv") != " ", F.col("conv")).cast(conv_type).alias("conv_id"),
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("digest", empty).alias("repaired_sha256"),
    )


# -- damage, to test repairs with ------------------------------------------


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """(rows with some roles and texts spoiled, how often each row then stands), by CRC-32 of conversation and turn."""
    key = F.concat(_conversation("conv_id"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    fate = F.col("_fate")
    spoiled = rows.withColumn("_fate", F.crc32(key) % 20).select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("_copies"),
    )
    return spoiled, F.col("_copies")
