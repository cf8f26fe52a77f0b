"""Mixing sources to target weights, by min-cost flow over overlapping sources.

Documents belong to one source or to several.  They are counted by the set of
their sources (their pattern), so the network has one node per pattern and one
per source, however many documents there are.  A pattern gives its words once
for nothing and every further time at a higher price; a source takes up to its
target.  The flow that fills the targets as far as possible, and among these
the cheapest, says how many words each pattern gives.  As prices hang on the
pattern's side alone and rise from pass to pass, the cheapest flow is found by
raising a largest flow pass by pass: what an earlier pass can do by changing
its ways is done before anything is repeated.

Sources that share no document with others need no network: they take the lesser
of their target and what their documents can give, in a column expression, and
there may be any number of them.  For those that overlap, each group of sources
that hang together is one network, solved in one task from its sums; it has a
row per pattern, not per document.

Targets follow from weights and from what sources can give: a source whose share
by weight is beyond its limit gets the limit, and the excess is shared again by
weight, until none is above.  Each round needs two sums.

From a pattern documents are chosen in the order of a seeded hash: all of them
as often as the flow goes round, and of the last round as many as fit.  Order is
found in two steps, by sums over ranges of the hash first, so that only the range
in which the flow ends is gone through row by row; there a document is taken if
it still fits.  Results hang on rows alone and not on partitions or tasks.

Defined results: a null text has no words, a document without words takes
nothing; a null source is a source of its own and comes last; repeated rows
count each on its own, and equal rows are interchangeable; texts of any length
are read whole; an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prsignal.llm.common import kept
from prsignal.llm.components import components

# What a word is, weights of sources in turn, the share of all words, and passes over a document.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (150, 100)
PASSES = 2
SEED = 20240117

# Ranges of the hash that a pattern is cut into: one for so many documents, within limits.
DOCUMENTS_PER_RANGE, MOST_RANGES = 2000, 1 << 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# -- targets ---------------------------------------------------------------


def numbered(names: DataFrame, column: str = "source") -> DataFrame:
    """``names`` with ``number``, their place in the order of code points from 0, null last.

    Rows are dealt by range and numbered in their range, and ranges are then
    added up: a row for each task.
    """
    null_last = [F.col(column).isNull(), F.col(column)]
    parts = kept(
        names.repartitionByRange(*[c.asc() for c in null_last])
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_in_part", F.row_number().over(Window.partitionBy("_part").orderBy(*null_last)) - 1)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(offsets, "_part").withColumn("number", F.col("_before") + F.col("_in_part")).drop(
        "_part", "_in_part", "_before"
    )


def targets(
    sources: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    passes: int = PASSES,
) -> DataFrame:
    """``sources`` (source, source_size) with ``number`` and ``target``.

    Weights go round in the order of the sources.  ``share`` is the part of all
    words, as a fraction, that the targets come to.  Two numbers a round reach
    the driver.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    table = kept(
        numbered(sources).withColumns({"weight": weight, "limit": (F.col("source_size") * passes).cast("double")})
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate = None
    while True:
        # At a rate, each source gets its weight times the rate, or its limit.
        capped = F.lit(False) if rate is None else F.col("weight") * rate > F.col("limit")
        sums = table.agg(
            F.sum(F.when(capped, F.col("limit"))).alias("at_limit"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).first()
        if not sums.weight:
            break
        before, rate = rate, (total * share[0] / share[1] - (sums.at_limit or 0.0)) / sums.weight
        if before is not None and rate <= before:
            break
    target = F.col("limit") if rate is None else F.least("limit", F.col("weight") * rate)
    return kept(table.select("source", "number", "source_size", target.alias("target")))


# -- flow ------------------------------------------------------------------


def cheapest_flow(
    sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], passes: int = PASSES
) -> list[list[int]]:
    """Words that each pattern gives to each of its sources (in the order of ``members``).

    As much as possible of the quotas is filled; among all ways the one that
    repeats least, where a second pass over a pattern costs more than a first, a
    third more than a second, and so on.
    """
    flow = [[0] * len(m) for m in members]
    left = list(quotas)
    users: list[list[tuple[int, int]]] = [[] for _ in quotas]
    for p, m in enumerate(members):
        for i, s in enumerate(m):
            users[s].append((p, i))
    for _ in range(passes):
        spare = list(sizes)
        exhausted: set[int] = set()
        while True:
            # Shortest ways from a pattern with spare words to a source with room, level by level.
            via: dict[tuple[str, int], tuple[int, int] | None] = {}
            waiting = deque()
            for p, n in enumerate(spare):
                if n > 0 and p not in exhausted:
                    via["p", p] = None
                    waiting.append(("p", p))
            end = None
            while waiting and end is None:
                kind, at = waiting.popleft()
                if kind == "p":
                    for i, s in enumerate(members[at]):
                        if ("s", s) not in via:
                            via["s", s] = (at, i)
                            if left[s] > 0:
                                end = s
                                break
                            waiting.append(("s", s))
                else:
                    # Words that another pattern gives this source could go elsewhere.
                    for p, i in users[at]:
                        if flow[p][i] > 0 and ("p", p) not in via:
                            via["p", p] = (at, i)
                            waiting.append(("p", p))
            if end is None:
                break
            way, node, room = [], ("s", end), left[end]
            while via[node] is not None:
                if node[0] == "s":
                    p, i = via[node]
                    way.append((p, i, 1))
                    node = ("p", p)
                else:
                    s, i = via[node]
                    way.append((node[1], i, -1))
                    room = min(room, flow[node[1]][i])
                    node = ("s", s)
            room = min(room, spare[node[1]])
            for p, i, sign in way:
                flow[p][i] += sign * room
            spare[node[1]] -= room
            left[end] -= room
    return flow


def _flows(patterns: DataFrame, sources: DataFrame, passes: int) -> DataFrame:
    """(key, given) of patterns of overlapping sources: the words that each gives."""
    of_source = sources.select("source", "number", "target").withColumnRenamed("source", "_source")
    pairs = kept(
        patterns.select("key", "pattern_size", F.explode("pattern").alias("source"))
        .join(of_source, F.col("source").eqNullSafe(F.col("_source")))
        .select("key", "pattern_size", "number", "target")
    )
    # Sources that hang together: each is linked to the first of every pattern it is in.
    first = pairs.groupBy("key").agg(F.min("number").alias("v"))
    network = components(pairs.join(first, "key").select(F.col("number").alias("u"), "v"))
    nodes = F.array_sort(F.collect_list(F.struct("number", "target")))
    # A source that is linked to no other is a network of its own.
    component = F.coalesce("component", "number")
    tables = (
        pairs.join(network.withColumnRenamed("node", "number"), "number", "left")
        .withColumn("component", component)
        .groupBy("component", "key", "pattern_size")
        .agg(nodes.alias("nodes"))
    )

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        lists = [[(n["number"], n["target"]) for n in nodes] for nodes in group["nodes"]]
        quota = {number: round(target) for nodes in lists for number, target in nodes}
        place = {number: i for i, number in enumerate(sorted(quota))}
        flow = cheapest_flow(
            [int(n) for n in group["pattern_size"]],
            [[place[number] for number, _ in nodes] for nodes in lists],
            [quota[number] for number in sorted(quota)],
            passes,
        )
        return pd.DataFrame({"key": group["key"], "given": [sum(f) for f in flow]})

    return tables.groupBy("component").applyInPandas(solve, "key string, given long")


def given_words(patterns: DataFrame, sources: DataFrame, passes: int = PASSES) -> DataFrame:
    """``patterns`` (key, pattern, pattern_size, n_docs) with ``given``, the words of the mix that come from each."""
    columns = ["key", "pattern_size", "n_docs", "given"]
    # Sources of which some document has another source too.
    shared = kept(
        patterns.where(F.size("pattern") > 1)
        .select(F.explode("pattern").alias("source"))
        .groupBy("source")
        .agg(F.lit(True).alias("shared"))
    )
    single = patterns.where(F.size("pattern") == 1).withColumn("only", F.col("pattern")[0])
    same = F.col("only").eqNullSafe(F.col("source"))
    alone = single.join(shared, same, "left").where("shared IS NULL").drop("source", "shared")
    settled = alone.join(sources.select("source", "target"), same).withColumn(
        "given", F.least(F.round("target").cast("long"), F.col("pattern_size") * passes)
    )
    if shared.isEmpty():
        return settled.select(*columns)
    settled = kept(settled.select(*columns))
    overlapping = patterns.join(settled.select("key"), "key", "left_anti")
    flows = _flows(kept(overlapping), sources, passes)
    # Documents of no source give nothing.
    rest = overlapping.join(flows, "key", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    return settled.unionByName(rest.select(*columns))


# -- choice ----------------------------------------------------------------


def _fill(batches):
    """Rows with ``fits``, in the ranges in which flows end: documents are taken in order while they fit."""
    at, room = None, 0
    for b in batches:
        out = []
        for pattern, size, left in zip(*(b.column(c).to_pylist() for c in ("key", "size", "room"))):
            if pattern != at:
                at, room = pattern, left
            fits = 0 < size <= room
            room -= size if fits else 0
            out.append(fits)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "fits"])


def chosen(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` (doc_id, size, draw, key) with ``taken``: its words times the passes the mix makes over it."""
    ranges = F.least(F.greatest(F.ceil(F.col("n_docs") / DOCUMENTS_PER_RANGE), F.lit(1)), F.lit(MOST_RANGES))
    some = F.col("pattern_size") > 0
    plan = plan.select(
        "key",
        F.when(some, F.expr("given div pattern_size")).otherwise(0).alias("rounds"),
        F.when(some, F.expr("given % pattern_size")).otherwise(0).alias("rest"),
        ranges.cast("long").alias("ranges"),
    )
    place = F.expr("shiftrightunsigned(draw, 32) * ranges div 4294967296")
    docs = kept(sized.join(plan, "key").withColumn("range", place).drop("ranges"))
    sums = docs.groupBy("key", "rest", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # The room that is left when a range begins; the flow ends in the range that has more words than that.
    room = F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))
    rooms = kept(sums.withColumn("room", room).select("key", "range", "room", (room >= F.col("words")).alias("whole")))
    placed = docs.join(rooms, ["key", "range"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", fits boolean"
    filled = (
        placed.where("NOT whole AND room > 0")
        .repartition("key", "range")
        .sortWithinPartitions("key", "draw", "doc_id", "size")
        .mapInArrow(_fill, schema)
    )
    others = placed.where("whole OR room <= 0").withColumn("fits", F.col("whole"))
    taken = F.col("size") * F.col("rounds") + F.when(F.col("fits"), F.col("size")).otherwise(0)
    return filled.unionByName(others).select("doc_id", "key", "size", taken.alias("taken"))


def mixed(
    docs: DataFrame,
    pattern: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    passes: int = PASSES,
    seed: int = SEED,
    size: Callable[[Column], Column] = n_words,
) -> DataFrame:
    """(doc_id, size, taken, pattern, source_size, target): how much the mix takes of each document.

    ``pattern`` gives the array of a document's sources, in ascending order and
    each once; by default its ``source`` alone.  The last two columns are those
    of a document's source where it has one only, else null.
    """
    names = F.array("source") if pattern is None else pattern
    text = F.coalesce("text", F.lit(""))
    sized = kept(
        docs.select("doc_id", names.alias("pattern"), text.alias("text")).select(
            "doc_id",
            # Tells a null source from one of that name.
            F.to_json(F.struct("pattern")).alias("key"),
            "pattern",
            size(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "text", "doc_id").alias("draw"),
        )
    )
    patterns = kept(
        sized.groupBy("key", "pattern").agg(F.sum("size").alias("pattern_size"), F.count(F.lit(1)).alias("n_docs"))
    )
    sources = targets(
        patterns.select(F.explode("pattern").alias("source"), "pattern_size")
        .groupBy("source")
        .agg(F.sum("pattern_size").alias("source_size")),
        weights,
        share,
        passes,
    )
    plan = kept(given_words(patterns, sources, passes))
    only = F.when(F.size("pattern") == 1, F.col("pattern")[0])
    of_pattern = (
        patterns.select("key", "pattern", only.alias("only"), (F.size("pattern") == 1).alias("one"))
        .join(sources, F.col("one") & F.col("only").eqNullSafe(F.col("source")), "left")
        .select("key", "pattern", "source_size", "target")
    )
    return chosen(sized.drop("pattern"), plan).join(of_pattern, "key").drop("key")
