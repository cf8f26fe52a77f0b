"""Phrases, conversations and mixtures against brute force, on small made-up rows with every odd case."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prsignal.llm import dialogue, mixing, phrases, queries

SF = "/root/testdata/sf0.001"


# -- phrases ---------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def best_phrases(rows, least, best, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in frequent.items():
            inside = any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in frequent.items()
            )
            if len(p) > 1 and not inside:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                phrase = " ".join(p)
                found.append((-score, -a, phrase.encode(), (phrase, a, counts[p[:k]], counts[p[k:]], n[lang], score)))
        found.sort()
        out += [(lang, rank, *row) for rank, (*_, row) in enumerate(found[:best], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = ["a", "B", "b", "cc", "Dé", "é", "x\x1fy", "\x85", "　"]
    marks = [" ", " ", " ", "\t", "  ", ". ", "\n", ";", "!?", "\r\n", "\x0b"]
    rows = [(None, None), ("en", ""), ("en", " \t "), (None, "..,"), ("en", "a" * 200_000), ("", "a b a b a b")]
    for _ in range(120):
        weights = [9, 3, 2, 2, 1, 1, 1, 1, 1]
        text = "".join(rng.choices(words, weights)[0] + rng.choice(marks) for _ in range(rng.choice([2, 20, 60])))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows + rows[10:20]


def run_phrases(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("least, best", [(3, 2000), (10, 7), (300, 5)])
def test_phrases_equal_brute_force(spark, texts, least, best):
    rows = [(i, lang, text, "x", "y") for i, (lang, text) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase string, n string").repartition(5)
    assert run_phrases(df, min_count=least, best=best) == best_phrases(texts, least, best)


def test_no_texts_have_no_phrases(spark):
    assert run_phrases(spark.createDataFrame([], "lang string, text string")) == []
    assert run_phrases(spark.createDataFrame([(None, None)], "lang string, text string")) == []


def test_words_are_the_same_in_chunks_of_any_size(texts):
    data = [(t or "").encode() for _, t in texts]
    ((whole, n),) = phrases.words_of(data)
    assert n == len(whole)
    for chunk in (1, 7, 100, 5000):
        at = 0
        for words, own in phrases.words_of(data, chunk):
            assert words == whole[at : at + len(words)] and len(words) >= min(own + 4, len(whole) - at)
            at += own
        assert at == n


def test_quicksort_counts_all_frequent_prefixes():
    rng = np.random.default_rng(3)
    for least, values in ((1, 2), (5, 4), (40, 3)):
        words = rng.integers(1, values + 1, (400, 5))
        for row, end in zip(words, rng.integers(1, 6, 400)):
            row[end:] = 0
        weights = rng.integers(1, 9, 400)
        want = Counter()
        for row, n in zip(words.tolist(), weights.tolist()):
            for k in range(1, 6):
                if row[k - 1]:
                    want[tuple(row[:k])] += n
        got = [(tuple(words[r, :d].tolist()), n) for r, d, n in phrases.frequent_prefixes(words, weights, least)]
        assert len(got) == len(dict(got)) and dict(got) == {p: n for p, n in want.items() if n >= least}


def test_scores_beyond_64_bits_are_exact(spark):
    n, a, l, r = 10**13, 10**11 + 7, 3 * 10**11 + 1, 10**11 + 9
    counts = spark.createDataFrame([("x", "a", l), ("x", "b", r), ("x", "a b", a)], "lang string, phrase string, n long")
    row = phrases.scored(counts, spark.createDataFrame([("x", n)], "lang string, n long")).first()
    assert row.score == 1000 * a * n // (l * r) and (row.l, row.r, row.n) == (l, r, n)


def test_the_sieve_lets_all_frequent_words_and_pairs_through(spark, texts):
    df = spark.createDataFrame([(lang or "und", t or "") for lang, t in texts], "lang string, text string")
    full = {tuple(r) for r in phrases.counted(df, min_count=3, bits=16)[0].collect()}
    open_ = {tuple(r) for r in phrases.counted(df, min_count=1, bits=16)[0].collect()}
    assert full == {r for r in open_ if r[2] >= 3}


def test_a_window_is_one_row_of_a_task_however_much_text_it_reads(texts, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 200)
    monkeypatch.setattr(phrases, "ROWS", 7)
    langs, data = zip(*[(lang or "und", t or "") for lang, t in texts])
    batches = [pa.RecordBatch.from_pydict({"lang": langs[i : i + 9], "text": data[i : i + 9]}) for i in range(0, len(data), 9)]
    every = np.full((phrases.LEADING << phrases.BLOCK_BITS) // 8, 255, np.uint8)
    want = defaultdict(int)
    for lang, text in zip(langs, data):
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text.translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            want[lang, None] += len(words)
            for i in range(len(words)):
                want[lang, " ".join(words[i : i + 5])] += 1
    for most in (phrases.HELD, 20, 0):
        found = phrases._windows(iter(batches), phrases.BLOCK_BITS, every, 5, most)
        rows = [tuple(r.values()) for batch in found for r in batch.to_pylist()]
        sums = defaultdict(int)
        for lang, words, n in rows:
            sums[lang, words] += n
        assert sums == want
        if most == phrases.HELD:
            assert len(rows) == len(want)


def test_frequent_windows_stay_in_a_task_that_gives_out_rare_ones(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 1)
    data = [f"often. rare{i}. seldom{i}" for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 50, "text": data})
    every = np.full((phrases.LEADING << phrases.BLOCK_BITS) // 8, 255, np.uint8)
    found = phrases._windows(iter([batch]), phrases.BLOCK_BITS, every, 5, 5)
    rows = [tuple(r.values())[1:] for b in found for r in b.to_pylist()]
    assert rows.count(("often", 50)) == rows.count((None, 150)) == 1 and len(rows) == 102


def test_windows_come_from_few_tasks(spark, monkeypatch):
    df = spark.createDataFrame([("en", "a b c")] * 400, "lang string, text string").repartition(40)
    cores = spark.sparkContext.defaultParallelism
    tasks = lambda *a: phrases.in_large_tasks(df, *a).rdd.getNumPartitions()
    assert (tasks(0), tasks(2000), tasks(2001, 100), tasks(1 << 40)) == (cores, cores, 21, 40)
    plans, kept = [], phrases.kept
    monkeypatch.setattr(phrases, "kept", lambda df: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    phrases.counted(df, min_count=3)
    assert f"Coalesce {cores}\n" in plans[0]


# -- conversations ---------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def spoil(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        left = text.rstrip(WHITE)
        out.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repairs(rows, found):
    """Every repair that inserts at most two rows in one place: (cost, audit, lines)."""

    def inserted(state, n):
        lines = []
        for _ in range(n):
            state = WANTED[state]
            lines.append(f"{NAMES[state]}:")
        return state, lines

    def go(i, state, cost, audit, lines):
        if i == len(rows):
            for n in range(3):
                end, more = inserted(state, n)
                if end in ("", "a"):
                    yield cost + 5 * n, audit + "I" * n, lines + more
            return
        role, text, fault = rows[i][2], rows[i][3], found[i]
        for n in range(3):
            s, more = inserted(state, n)
            c, a, ls = cost + 5 * n, audit + "I" * n, lines + more
            yield from go(i + 1, s, c + 2, a + "D", ls)
            if fault not in ("b", "d"):
                late = 5 if fault == "t" else 0
                if (s, role[:1]) in AFTER:
                    yield from go(i + 1, AFTER[s, role[:1]], c + late, a + "K", [*ls, f"{role}:{text}"])
                yield from go(i + 1, WANTED[s], c + 1 + late, a + "R", [*ls, f"{NAMES[WANTED[s]]}:{text}"])

    return go(0, "", 0, "", [])


def digest_of(row):
    inner = hashlib.sha256(row[2].encode()).hexdigest() + row[3]
    return hashlib.sha256(inner.encode()).hexdigest()[:32]


def by_hand(rows):
    """What the operator should say about each conversation, after damage."""
    out, spoiled = {}, spoil(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in spoiled if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, digest_of(r)))
        found = faults(own)
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = min(repairs(own, found)) if own else (0, "", [])
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(found.count(f) for f in "bdt"), illegal, cost, audit, sha)
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "why?", "cut", "cut ", "", " \x0b", "end. \n", None, "é…", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "umpire"]
    rows = []
    for conv in range(150):
        for turn in range(rng.choice([1, 2, 3, 4, 5])):
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), rng.choice(roles[: rng.choice([2, 3, 9])]), rng.choice(texts)))
    return [*rows, (None, 1, "user", "a."), (None, 2, "assistant", "b."), *rows[:12]]


SCHEMA = "conv_id long, turn long, role string, text string"


def summaries(spark, rows, block=dialogue.BLOCK, partitions=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv string, same int").repartition(partitions)
    spoiled, copies = dialogue.damaged(df)
    turns = dialogue.turns(spoiled, copies)
    got = dialogue.summary(turns, dialogue.edits(turns, block)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_conversations_equal_brute_force(spark, talks, block):
    # Copies of rows double some conversations; all repairs of more than six rows are too many to list.
    size = Counter(r[0] for r in spoil(talks))
    rows = [r for r in talks if size[r[0]] <= 6]
    assert len(rows) > 300
    assert summaries(spark, rows, block) == by_hand(rows)


def test_no_conversations(spark):
    assert summaries(spark, []) == {}


def test_long_and_repeated_conversations_are_the_same_in_blocks_of_any_size(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"t{t}.", ""])) for t in range(3000)]
    rows += [(2, 7, "user", "same.")] * 5000 + [(3, None, "tool", f"{i}!") for i in range(300)]
    want = summaries(spark, rows)
    assert len(want) == 3 and want[2][2] == len(spoil([(2, 7, "user", "same.")] * 5000)) - 1
    assert summaries(spark, rows, block=100, partitions=7) == want
    codes = bytes(rng.randrange(16) for _ in range(400))
    cost, audit = dialogue.repair.__wrapped__(codes)
    assert cost == least_cost(codes) and len(audit.replace("I", "")) == 400


def least_cost(codes):
    """The least cost alone, over all states at once."""
    far, wanted = 10**9, {0: 2, 1: 2, 2: 3, 3: 2}
    after = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}

    def inserted(costs):
        for _ in range(3):
            costs = [min([costs[t], *(costs[s] + 5 for s in range(4) if wanted[s] == t)]) for t in range(4)]
        return costs

    costs = [0, far, far, far]
    for code in codes:
        costs, initial, fault = inserted(costs), code % 4, code // 4
        new = [c + 2 for c in costs]
        if fault in (0, 3):
            for s in range(4):
                late = 5 * (fault == 3)
                if (s, initial) in after:
                    new[after[s, initial]] = min(new[after[s, initial]], costs[s] + late)
                new[wanted[s]] = min(new[wanted[s]], costs[s] + 1 + late)
        costs = new
    costs = inserted(costs)
    return min(costs[0], costs[3])


def test_repaired_rows_are_in_order(spark, talks):
    turns = dialogue.turns(spark.createDataFrame(talks, SCHEMA))
    rows = dialogue.repaired(turns, dialogue.edits(turns)).orderBy("conv", "place").collect()
    lists = defaultdict(str)
    for r in rows:
        lists[r.conv] += r.role[0]
    assert lists and all(re.fullmatch("s?(ua)+", roles) for roles in lists.values())
    assert all(r.text == "" for r in rows if r.edit == "I")


# -- mixtures --------------------------------------------------------------


def fair_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, capped = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = goal - sum(2 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return {s: float(share.get(s, 2 * sizes[s])) for s in names}
        capped |= above


def check_mixture(rows, got):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))
    want = fair_targets(sizes)
    by_id = {i: (source, len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))) for i, source, text in rows}
    taken, smallest = Counter(), {}
    for r in got:
        source, size = by_id[r.doc_id]
        assert r.size == size and r.source_size == sizes[source] and r.target == pytest.approx(want[source], rel=1e-12)
        assert r.taken == 0 if size == 0 else r.taken in (0, size, 2 * size)
        taken[source] += r.taken
        smallest[source] = min(smallest.get(source, size), size) if size else smallest.get(source, 0)
    assert len(got) == len(rows)
    return {s: want[s] - taken[s] for s in want}


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(2)
    rows = []
    for i in range(7000):
        source = rng.choice(["big"] * 6 + ["b", "é", "\U0001f600", "zz", None, "", "null"])
        text = rng.choice([None, "", "\x85", " a\x0bb ", "w " * rng.randrange(1, 300)])
        rows.append((i, source, text))
    return [*rows, (7000, "one", "x y z"), (7001, "none", " ")]


def test_mixture_comes_near_its_targets(spark, sources):
    df = spark.createDataFrame(sources, "doc_id long, source string, text string").withColumn("size", F.lit("x"))
    got = mixing.mixed(df.repartition(6)).collect()
    off = check_mixture(sources, got)
    assert all(-0.5 <= n <= 3 for s, n in off.items() if s != "one"), off
    again = mixing.mixed(df.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert sorted((r.doc_id, r.taken) for r in mixing.mixed(df, seed=3).collect()) != sorted((r.doc_id, r.taken) for r in got)


def test_registered_mixture(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]
    off = check_mixture(rows, queries.QUERIES["op13_mixture"](spark, SF).collect())
    targets = fair_targets(Counter({s: sum(len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, o, t in rows if o == s) for s in {r[1] for r in rows}}))
    assert sum(abs(n) for n in off.values()) <= 0.05 * sum(targets.values())


def test_mixture_of_nothing_and_of_equal_rows(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    empty = mixing.mixed(spark.createDataFrame([(1, "a", None), (None, None, "")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    equal = mixing.mixed(spark.createDataFrame([(None, "a", "x y")] * 10, schema)).collect()
    assert sorted(r.taken for r in equal) == [2] * 5 + [4] * 5


def all_flows(sizes, members, quotas, passes):
    """The best (words, cost) by trying every flow."""
    best = (0, 0)
    arcs = [(p, s) for p, m in enumerate(members) for s in m]
    for flow in itertools.product(*(range(min(sizes[p] * passes, quotas[s]) + 1) for p, s in arcs)):
        given, got = Counter(), Counter()
        for (p, s), n in zip(arcs, flow):
            given[p] += n
            got[s] += n
        if all(given[p] <= passes * sizes[p] for p in given) and all(got[s] <= quotas[s] for s in got):
            cost = sum(max(given[p] - k * sizes[p], 0) for p in given for k in range(1, passes))
            best = max(best, (sum(flow), -cost))
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(6)
    for _ in range(60):
        n, m = rng.choice([(2, 2), (3, 2), (2, 3)])
        members = [sorted(rng.sample(range(m), rng.randrange(1, m + 1))) for _ in range(n)]
        sizes, quotas = [rng.randrange(3) for _ in range(n)], [rng.randrange(5) for _ in range(m)]
        flow = mixing.cheapest_flow(sizes, members, quotas, 2)
        given = [sum(f) for f in flow]
        got = [sum(f[mem.index(s)] for f, mem in zip(flow, members) if s in mem) for s in range(m)]
        assert all(g <= q for g, q in zip(got, quotas)) and all(0 <= g <= 2 * s for g, s in zip(given, sizes))
        assert (sum(given), -sum(max(g - s, 0) for g, s in zip(given, sizes))) == all_flows(sizes, members, quotas, 2)


def test_overlapping_sources(spark):
    rows = [(i, [["a"], ["a", "b"], ["b", "c"], ["d"], []][i % 5], "w " * (1 + i % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, sources array<string>, text string")
    got = mixing.mixed(df, pattern=F.col("sources")).collect()
    assert len(got) == 2000 and all(r.taken == 0 for r in got if not r.pattern)
    given = Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        given[tuple(r.pattern)] += r.taken
    d = next(r for r in got if r.pattern == ["d"])
    assert abs(given[("d",)] - d.target) <= 1
    # The three that hang together fill their quotas as far as they can.
    sizes = Counter()
    for r in got:
        sizes[tuple(r.pattern)] += r.size
    wanted = mixing.targets(
        spark.createDataFrame(
            [(s, sum(n for p, n in sizes.items() if s in p)) for s in "abcd"], "source string, source_size long"
        )
    ).collect()
    goal = sum(r.target for r in wanted if r.source != "d")
    most = 2 * sum(n for p, n in sizes.items() if p and p != ("d",))
    assert abs(sum(n for p, n in given.items() if p != ("d",)) - min(goal, most)) <= 5
