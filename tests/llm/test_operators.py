"""The operators for training data against brute force, on small made-up rows with every odd case."""

import hashlib
import math
import random
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prsignal.llm import bpe, exact, jaccard, langid, licenses, packing, quality, queries, simhash, suffixes, urls
from prsignal.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, id string, n string, row string"


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, long and odd texts; clashing extra columns."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(200)]
    texts = [None, "", " \n ", "a", "Word", "ß" * 300, "x" * 5000, "\U0001f600 é\t\x85\u3000z  \n\n q"]
    for _ in range(20):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 150]))]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [texts[10] + " " + texts[12], texts[12] * 40]
    rng.shuffle(texts)
    return [(3 * i, t, None if i % 5 else "en", "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark):
    """Equal rows, one id with two texts, a null id."""
    return spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "other"), (None, "a b c d"), (None, None)], "doc_id long, text string")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# -- byte-level BPE --------------------------------------------------------


def test_bpe_equals_tiktoken_and_round_trips(docs, rows, none):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(ranks), special_tokens={}
    )
    got = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect()
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        assert np.frombuffer(by_id[doc_id].ids, "<u4").tolist() == theirs.encode_ordinary(text or "")
        assert bytes(by_id[doc_id].decoded) == (text or "").encode()
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


# -- SimHash ---------------------------------------------------------------


def test_simhash_of_edited_texts(docs, rows, none, repeated):
    got = {r.doc_id: r for r in simhash.edited_fingerprints(docs).collect()}
    texts = [t or "" for _, t, *_ in rows]
    assert len(got) == len(rows)
    for i, (doc_id, *_) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(rows)]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited.encode()))
        assert r.fingerprint == f"{simhash.fingerprint(text):016x}"
        assert r.edited_fingerprint == f"{simhash.fingerprint(edited):016x}"
        assert r.near_edited == simhash.likeness(int(r.fingerprint, 16), int(r.edited_fingerprint, 16))
        assert r.near_next == simhash.likeness(int(r.fingerprint, 16), simhash.fingerprint(following))
    assert simhash.edited_fingerprints(none).count() == 0
    again = simhash.edited_fingerprints(repeated).collect()
    assert len(again) == 5 and len({r.fingerprint for r in again if r.n_chars == 7}) == 1


@pytest.mark.parametrize("radius, blocks", [(0, 1), (3, 6), (5, 8)])
def test_block_tables_find_every_fingerprint_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1]
    stored = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 8))) for b in base for _ in range(8)}
    table = spark.createDataFrame([(f"{x:016x}",) for x in [*stored, *stored]], "fingerprint string")
    asked = spark.createDataFrame([(f"{x:016x}",) for x in base] + [(None,)], "fingerprint string")
    got = {(int(r.query, 16), int(r.found, 16)) for r in simhash.within(asked, table, radius, blocks).collect()}
    assert got == {(a, b) for a in base for b in stored if (a ^ b).bit_count() <= radius}


def slow_fingerprint(text):
    """SimHash word by word and bit by bit."""
    words, mask = text.lower().split(), (1 << 64) - 1
    n, counts = min(5, len(words)), {}
    for at in range(len(words) - n + 1 if n else 0):
        h = 0
        for w in words[at : at + n]:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w.encode())) & mask
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        h ^= h >> 31
        counts[h] = counts.get(h, 0) + 1
    out = 0
    for bit in range(64):
        vote = sum((1 + math.log2(n)) * (1 if h >> bit & 1 else -1) for h, n in counts.items())
        out |= (vote > 2e-3) << bit
    return out


def test_neighbours_are_those_of_a_search_through_all_rows(spark, docs):
    found = simhash.edited_fingerprints(docs).select("doc_id", "fingerprint")
    prints = {r.doc_id: int(r.fingerprint, 16) for r in found.collect()}
    for radius, blocks in ((3, 6), (12, 14)):
        near = 0
        for r in simhash.neighbours(found, F.col("doc_id") % 2 == 0, radius, blocks).collect():
            own = prints[r.doc_id]
            close = [n for o in set(prints.values()) - {own} if (n := (o ^ own).bit_count()) <= radius]
            want = (len(close), min(close, default=None)) if r.doc_id % 2 == 0 else (None, None)
            assert (r.n_within, r.least_distance) == want
            near += len(close)
    assert near > 0


def test_registered_simhash_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op2_simhash"](spark, SF).collect()}
    own = {d.doc_id: slow_fingerprint(d.text or "") for d in docs}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        # A vote that is nearly even may be rounded either way.
        assert (int(r.fingerprint, 16) ^ own[d.doc_id]).bit_count() <= 1
        others = {int(o.fingerprint, 16) for o in got.values()} - {int(r.fingerprint, 16)}
        near = [n for o in others if (n := (o ^ int(r.fingerprint, 16)).bit_count()) <= 3]
        asked = d.doc_id % 50 == 0
        assert (r.n_within, r.least_distance) == ((len(near), min(near, default=None)) if asked else (None, None))


def test_registered_bpe_and_packing(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ranks = bpe.parse_ranks(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = queries.QUERIES["op1_byte_bpe"](spark, SF).collect()
    assert len(encoded) == len(docs)
    for r in encoded:
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(docs[r.doc_id].encode())
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in queries.QUERIES["op6_best_fit"](spark, SF).collect():
        pieces[r.doc_id, r.piece] = r.ids_crc32
    want = {}
    for doc_id, text in docs.items():
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[doc_id, k // 2048] = zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())
    assert pieces == want


# -- url rules -------------------------------------------------------------


def test_url_rules_by_brute_force(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("a.b.org/es/x", "allow")]
    pieces = [["", "http://", "x://"], ["org", "ORG", "example.org", "www.Example.org", "a.b.org", "borg", ""],
              ["", "/", "/es/x", "/es/", "/en/12", "/en/2", "/é"], ["", "?q=/es/", "#/es/"]]
    made = [a + b + c + d for a in pieces[0] for b in pieces[1] for c in pieces[2] for d in pieces[3]]
    table = spark.createDataFrame([*enumerate([*made, None, made[5]])], "page_id long, url string")
    for r in urls.judge(table, rules).join(table, "page_id").collect():
        host = path = ""
        if "://" in (r.url or ""):
            rest = r.url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [
            (len(rule), rule, verdict)
            for rule, verdict in rules
            for h, p in [rule.split("/", 1)]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        ]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want)
    assert urls.judge(table, []).where("rule IS NOT NULL OR verdict = 'block'").count() == 0
    assert urls.judge(table.limit(0), rules).count() == 0


def test_url_index_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda data: len(data) % 2)  # nearly all keys collide
    (tmp_path / "index").write_bytes(urls.index_bytes([("a/", "block"), ("b/c", "allow"), ("b/", "allow"), ("b/", "block")]))
    index = urls.Index(str(tmp_path / "index"))
    assert index.judge(["a", "x.b", "c"], ["/", "/cd", "/"]) == [("a/", "block"), ("b/c", "allow"), (None, "allow")]
    assert index.judge(["b"], ["/x"]) == [("b/", "block")]


# -- language --------------------------------------------------------------


def test_language_on_held_out_rows(spark, none):
    got = queries.QUERIES["op4_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    got = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_of_odd_rows(docs, rows, none):
    model = langid.train([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 10)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for doc_id, text, *_ in rows:
        letters = any(map(str.isalpha, text or ""))
        assert (got[doc_id].lang_pred == "und") == (not letters) and 0 <= got[doc_id].score <= 1
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert langid.accepted(docs, model).columns == docs.columns
    assert model.predict("the dog")[0] == "en" and model.predict("die Katze")[0] == "de"


# -- quality ---------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    larger = "/root/testdata/sf0.01"  # the smallest tables have too few held-out labels
    got = queries.QUERIES["op5_quality"](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id")
    got = got.where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got) > 0
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_of_odd_rows(docs, rows, spark, none):
    labels = spark.createDataFrame([(3 * i, i % 2) for i in range(20)] + [(0, None), (None, 1)], "doc_id long, quality int")
    got = quality.scored(docs, labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.scored(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality.scored(none, labels, F.lit(True)).count() == 0


def test_isotonic_is_the_nearest_rising_sequence():
    assert quality._isotonic(np.array([1.0, 3, 2, 2, 5]), np.ones(5)).tolist() == [1, 7 / 3, 7 / 3, 7 / 3, 5]


# -- packing ---------------------------------------------------------------


def test_packing_is_whole_gapless_and_tight(docs, rows, repeated, none):
    data = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    whole = Tokenizer.from_str(data.decode())
    capacity = 64
    marked = ["one <|endoftext|> two", "<|startoftext|><|endoftext|>", "a<|ENDOFTEXT|>b <|", "x" * 3000 + "<|endoftext|>\n é"]
    marked = [(10**6 + i, text, "en", "x", "y", "z") for i, text in enumerate(marked)]
    rows = [*rows, *marked]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(marked, SCHEMA))
    got = packing.packed(docs, data, capacity).toPandas()
    want = {}
    for doc_id, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[doc_id, k // capacity] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert (group.length.cumsum() - group.length == group.offset).all() and group.length.sum() <= capacity
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / capacity) + 1
    assert packing.packed(repeated, data).count() == 5 and packing.packed(none, data).count() == 0


def test_evolved_packings_hold_the_same_lengths_and_are_no_worse():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(20, 70) for _ in range(200)), reverse=True)
    plain, best = packing.best_fit(lengths, 100), packing.evolve(lengths, 100, 3)
    assert sorted(n for g in best for n in g) == lengths[::-1] and max(map(sum, best)) <= 100
    assert packing.fitness(best, 100) >= packing.fitness(plain, 100)
    child = packing.crossover(plain, best, 100, rng)
    assert sorted(n for g in child for n in g) == lengths[::-1] and max(map(sum, child)) <= 100
    assert packing.as_groups(packing.as_numbers(best, lengths), lengths)


# -- licenses --------------------------------------------------------------


def test_license_notices(spark, none):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = [None, "", "no notice", mit, f"One. {apache} Two.\n{mit}", apache.replace("2.0", "1.1"), mit + "\n" + mit, "a license " * 3000]
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, texts[r.doc_id][r.start : r.start + r.length], r.license) for r in licenses.scan(table).collect())
    m, a = mit[:-1], apache[:-1]
    assert got == [(3, m, "MIT"), (4, a, "Apache-2.0"), (4, m, "MIT"), (6, m, "MIT"), (6, m, "MIT")]
    assert licenses.scan(none).count() == 0


def test_license_query_by_plain_search(spark):
    got = {r.doc_id: r.licenses for r in queries.QUERIES["op7_licenses"](spark, SF).collect()}
    short = {w: name for name, w in licenses.WORDINGS if len(w) < 80}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[r.doc_id] == (",".join(sorted({n for w, n in short.items() if w in r.text})) or None)


@pytest.mark.parametrize("size", [10_000, 100_000, 1_000_000])
def test_license_notices_within_long_lines(size):
    rng = random.Random(size)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    line = " ".join(rng.choice(vocabulary) for _ in range(size // 5))
    middle = line.index(" ", len(line) // 2)
    for name, wording in licenses.WORDINGS:
        got = licenses.notices(f"{line[:middle]} {wording}{line[middle:]}")
        assert [(r["license"], r["start"], r["differences"]) for r in got] == [(name, middle + 1, [])]


@pytest.mark.parametrize("between", ["\n", "\n\n", "\n * "])
@pytest.mark.parametrize("width", [1, 20, 35, 45, 50])
def test_license_notices_in_short_lines(width, between):
    for name, wording in licenses.WORDINGS:
        lines = textwrap.wrap(wording, width, break_long_words=False, break_on_hyphens=False)
        text = "One two.\n" + between.join(lines) + "\nThree."
        assert [(r["license"], r["differences"]) for r in licenses.notices(text)] == [(name, [])]


def test_licenses_are_told_apart(spark):
    long = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    for name, title, version in [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-3.0", "Lesser", "3"), ("LGPL-2.1", "Lesser", "2.1"),
                                 ("LGPL-2.0", "Library", "2"), ("AGPL-3.0", "Affero", "3")]:
        assert [r["license"] for r in licenses.notices(long.format(title, version))] == [name]
        assert [r["license"] for r in licenses.notices(f"This work is licensed under the GNU {title} General Public License, version {version}.")] == [name]
    assert licenses.notices(long.format("", "9")) == licenses.notices("licensed under the GNU General Public License, version 4.") == []
    for name, wording in licenses.WORDINGS:
        assert [r["license"] for r in licenses.notices(f"One. {wording}\nTwo.")] == [name]
    three = dict(licenses.WORDINGS)["BSD-3-Clause"].replace("the copyright holder", "The Example Project")
    assert [r["license"] for r in licenses.notices(three)] == ["BSD-3-Clause"]
    table = spark.createDataFrame([(1, "Take it, it is yours. Released under the MIT License.")], "doc_id long, text string")
    own = [("Own", "take it; it is yours")]
    for templates in (own, spark.createDataFrame(own, "name string, wording string")):
        assert [r.license for r in licenses.scan(table, templates=templates).collect()] == ["Own"]
    assert licenses.scan(table, templates=[]).count() == 0
    for bad in ([("Own", "!")], [("Own", "a " * 10_001)], [("Own", f"word {i}") for i in range(1001)]):
        with pytest.raises(ValueError):
            licenses.scan(table, templates=bad)


def _notices_by_words(text):
    """Licenses and places by aligning every wording with the whole text, without blocks or compression."""
    wordings = licenses.prepared(licenses.WORDINGS)
    found = licenses.words(text)
    have = [w for w, _, _ in found]
    whole = {k: [(0, len(have))] for k in range(len(wordings.words))}
    all_places = licenses.contenders(wordings, have, text, found, whole)
    taken, out = set(), set()
    for k, start, end, differ in sorted(all_places, key=lambda p: (len(p[3]) - len(wordings.words[p[0]]), p[0], p[1])):
        if taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            out.add((licenses.WORDINGS[k][0], found[start][1], found[end - 1][2] - found[start][1]))
    return out


def _by_compression(text):
    return {(r["license"], r["start"], r["length"]) for r in licenses.notices(text)}


def test_license_recall_against_search_by_words(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(7)
    vocabulary = sorted({w for t in texts for w, _, _ in licenses.words(t or "")})
    for _, wording in licenses.WORDINGS * 3:
        # A tenth of the words at most is left out, added or replaced.
        changed = wording.split()
        for _ in range(rng.randrange(0, len(changed) // 12 + 1)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(2))
        line = rng.choices(vocabulary, k=rng.randrange(20, 2000))
        at = rng.randrange(len(line) + 1)
        texts.append(" ".join(line[:at] + changed + line[at:]))
    want = [_notices_by_words(t or "") for t in texts]
    got = [_by_compression(t or "") for t in texts]
    assert sum(map(len, want)) > 120
    both = sum(len(w & g) for w, g in zip(want, got))
    assert both >= 0.95 * sum(map(len, want)) and both >= 0.95 * sum(map(len, got))


def test_license_compression_decides(monkeypatch):
    text = "Some words before. Released under the MIT License. Some words after."
    assert len(licenses.notices(text)) == 1
    monkeypatch.setattr(licenses.Wordings, "saved", lambda self, part, among: [0 for _ in among])
    assert licenses.notices(text) == []


def test_license_differences_are_the_fewest():
    rng = random.Random(3)

    def fewest(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, above = [i + 1], row
            for j, y in enumerate(b):
                row.append(above[j] if x == y else 1 + min(above[j + 1], row[j]))
        return row[-1]

    for _ in range(300):
        want, have = (rng.choices("abcd", k=rng.randrange(2, 9)) for _ in range(2))
        got = licenses.occurrences(want, have, len(want) - 1)
        best = min(fewest(want, have[i:j]) for j in range(len(have) + 1) for i in range(j + 1))
        assert min((n for n, _, _ in got), default=len(want)) == best
        assert all(len(licenses.differences(want, have[i:j])) == n == fewest(want, have[i:j]) for n, i, j in got)


# -- repeated passages -----------------------------------------------------


def test_content_order_and_classes():
    rng = np.random.default_rng(5)
    for n, width, letters in [(1, 5, 2), (40, 9, 2), (300, 21, 2), (200, 63, 1), (120, 8, 3)]:
        groups = np.sort(rng.integers(0, 4, n))
        content = rng.integers(0, letters, (n, width)).astype(np.uint8)
        content[n // 2 :] = content[: n - n // 2]  # equal rows, in groups of their own too
        order = suffixes.content_order(groups, content)
        rows = [(int(g), bytes(c)) for g, c in zip(groups, content)]
        assert [rows[i] for i in order] == sorted(rows)
        assert sorted(order.tolist()) == list(range(n))
        numbers = suffixes.classes(groups, content)
        for depth in range(width + 1):
            name = {}
            for i, (g, c) in enumerate(rows):
                assert name.setdefault((g, c[:depth]), numbers[i, depth]) == numbers[i, depth]
            assert len(set(name.values())) == len(name)




def without_repeats(rows, threshold):
    seen, out = set(), {}
    for doc_id, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - threshold + 1):
            s = data[p : p + threshold]
            if s in seen:
                covered[p : p + threshold] = b"\1" * threshold
            seen.add(s)
        out[doc_id] = (len(data), bytes(x for x, c in zip(data, covered) if not c))
    return out


@pytest.mark.parametrize("threshold, hot", [(100, 20_000), (20, 20_000), (20, 1), (7, 2)])
def test_repeated_strings_by_brute_force(docs, rows, threshold, hot):
    want = without_repeats([r[:2] for r in rows], threshold)
    got = suffixes.without_repeats(docs, threshold, hot=hot).collect()
    assert {r.rest.doc_id: (r.n_bytes, bytes(r.left)) for r in got} == want
    assert all(sum(s.hi - s.lo for s in r.spans) == r.n_bytes - len(r.left) for r in got)


def test_repeats_in_blocks_whole_characters_and_odd_rows(spark, monkeypatch, repeated, none):
    monkeypatch.setattr(suffixes, "BLOCK", 64)  # in the driver; long texts in several blocks
    data = np.frombuffer(("abcdefg" * 100 + "é" * 200).encode(), np.uint8)
    at = suffixes.anchors(data, 20)[0]
    monkeypatch.undo()
    assert set(at.tolist()) == set(suffixes.anchors(data, 20)[0].tolist())
    got = suffixes.without_repeats(spark.createDataFrame([(1, "é" * 90), (2, "xé" + "é" * 80)], "doc_id long, text string"), 21, True)
    for r in got.collect():
        bytes(r.left).decode()
    got = suffixes.without_repeats(repeated, 7).collect()
    assert sorted((r.rest.doc_id or 0, len(r.left)) for r in got) == [(0, 0), (0, 7), (1, 0), (1, 0), (1, 5)]
    assert suffixes.without_repeats(none).count() == 0


def test_rows_of_one_id_whose_texts_have_one_short_hash(spark):
    texts = ["zwok pukk wsgh lkdt upfq jpa", "pjrt jfrz qhgp sdbc bkot jst"]  # F.hash of both is 271610586
    table = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert table.select(F.hash("text")).distinct().count() == 1
    assert sorted(bytes(r.left).decode() for r in suffixes.without_repeats(table, 20).collect()) == sorted(texts)
    both = table.union(spark.createDataFrame([(k, f"{t} x") for k, t in enumerate(texts)], table.schema))
    got = jaccard.similar(both, 2, (80, 100)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("0", "None"), ("1", "None"), ("None", "None"), ("None", "None")]
    assert sum(r.kept for r in got) == 2


@pytest.mark.parametrize("n_buckets", [48, 800])
def test_buckets_of_suffixes_are_even(n_buckets):
    data = np.random.default_rng(8).integers(97, 123, 1_200_000, dtype=np.uint8)
    table = pa.table({"id": [1], "tie": pa.array([0], pa.int32()), "text": [data.tobytes()]})
    sent = {}
    for batch in suffixes._scan(100, n_buckets)(iter(table.to_batches())):
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
            sent[bucket] = sent.get(bucket, 0) + len(suffixes.unpacked(block)[0])
    assert len(sent) == n_buckets and max(sent.values()) < 2 * sum(sent.values()) / n_buckets


# -- exact copies ----------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_copies_also_when_hashes_collide(docs, rows, bits):
    weak = F.xxhash64 if bits == 64 else lambda c: F.xxhash64(c) % 3
    got = {r.doc_id: r for r in exact.copies(docs, hash_of=weak).collect()}
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    for text, ids in groups.items():
        for doc_id in ids:
            r = got[doc_id]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), doc_id == max(ids))
            assert r.text_sha256 == sha(text.encode())


def test_exact_copies_of_odd_rows(repeated, none):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.copies(repeated).collect()]
    assert sorted(map(str, got)) == sorted(
        map(str, [(1, 1, 3, True), (1, 1, 3, False), (1, 1, 1, True), (None, 1, 3, False), (None, None, 1, True)])
    )
    assert exact.copies(none).count() == 0


def test_chunks_are_the_text_and_end_by_content(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abc defgh.\n") for _ in range(9000)) + "q" * 9000
    table = spark.createDataFrame([(text,), ("zz" + text,)], "text string")
    one, two = (r[0] for r in table.select(exact.chunks(F.col("text"))).collect())
    assert "".join(one) == text and max(map(len, one)) == exact.MAX_CHUNK
    assert len(set(one) & set(two)) >= 5


# -- Jaccard join ----------------------------------------------------------


def linked_components(rows, n, p, q):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    above = list(range(len(rows)))

    def find(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and q * len(a & b) >= p * len(a | b):
                x, y = find(i), find(j)
                above[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {doc_id: (len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)}


@pytest.mark.parametrize("n, p, block", [(3, 90, 4_000_000), (5, 80, 4_000_000), (2, 60, 200)])
def test_similar_documents_by_brute_force(docs, rows, n, p, block):
    got = jaccard.similar(docs, n, (p, 100), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked_components([r[:2] for r in rows], n, p, 100)
    assert sum(r.kept for r in got) == len({r.component_id for r in got})


def test_similar_odd_rows(repeated, none):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar(repeated).collect())
    assert got == [("1", 1, "1"), ("1", 1, "None"), ("1", 1, "None"), ("None", 0, "None"), ("None", 1, "None")]
    assert jaccard.similar(none).count() == 0


def test_a_null_id_is_not_the_smallest_of_a_component(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(7, words), (None, words), (5, words + " more"), (None, "alone here now"), (3, ""), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op10_ngram_jaccard"](spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [
        ("3", 0, "3"), ("5", 39, "5"), ("7", 38, "5"), ("None", 0, "None"), ("None", 1, "None"), ("None", 38, "5"),
    ]


def test_signature_trees_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (12, 60), dtype=np.uint64)
    sets = []
    for i in range(400):
        s = base[i % 12].copy()
        s[rng.integers(0, 60, i % 9)] = rng.integers(0, 1 << 63, dtype=np.uint64)
        sets.append(np.unique(s))
    want = {(i, j) for i in range(400) for j in range(i) if jaccard.linked(sets[i], sets[j], (80, 100))}

    def classes(pairs, n=400):
        union = jaccard.Union(n)
        for i, j in pairs:
            a, b = union.find(i), union.find(j)
            union.above[max(a, b)] = min(a, b)
        return union.roots(0, n).tolist()

    found = jaccard.tree_links(sets, None, (80, 100))
    assert all(jaccard.linked(sets[i], sets[j], (80, 100)) for i, j in found)
    assert classes(found) == classes(want)
    across = [(i, j + 150) for i, j in jaccard.tree_links(sets[:150], sets[150:], (80, 100))]
    assert classes(across) == classes({(j, i) for i, j in want if j < 150 <= i})


def test_sketches_lose_no_link_and_part_sets_that_share_a_passage():
    rng = np.random.default_rng(5)
    passage, sets = rng.integers(0, 1 << 63, 120, np.uint64), []
    for i in range(150):
        n = int(rng.choice([3, 30, 120, 250, 256, 257, 400, 1000]))
        base = np.unique(np.r_[rng.integers(0, 1 << 63, n, np.uint64), passage if i % 3 else passage[:0]])
        for part in rng.choice([0.7, 0.8, 0.9, 1.0], 3):
            sets.append(base[: max(1, int(len(base) * part))])
    for p in (50, 80, 90):
        found = jaccard.alike(np.array([len(x) for x in sets]), [jaccard.sketch(x) for x in sets], (p, 100))
        union = jaccard.Union(len(sets))
        for a, b in found:
            union.above[union.find(a)] = union.find(b)
        for i in range(len(sets)):
            for j in range(i):
                if jaccard.linked(sets[i], sets[j], (p, 100)):
                    assert union.find(i) == union.find(j)
    assert all(jaccard.linked(sets[a], sets[b], (70, 100)) for a, b in found if min(len(sets[a]), len(sets[b])) > 60)


def test_similar_documents_in_stars_of_many_blocks(docs, monkeypatch):
    want = sorted((r.doc_id, r.component_id) for r in jaccard.similar(docs, 1, (80, 100)).collect())
    monkeypatch.setattr(jaccard, "STAR", 2)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similar(docs, 1, (80, 100)).collect()) == want


def test_linked_sets_share_a_slice():
    rng = np.random.default_rng(6)
    lows, counts = jaccard.bands((80, 100))
    for size in (4, 5, 9, 17, 40, 300):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = np.unique(np.r_[a[int(rng.integers(0, size // 5 + 1)) :], rng.integers(0, 1 << 63, 1, dtype=np.uint64)])
            if jaccard.linked(a, b, (80, 100)) and len(a) * 20 // 100 and len(a) != len(b):
                assert set(jaccard.slices(a, (80, 100), lows, counts)) & set(jaccard.slices(b, (80, 100), lows, counts))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# -- registered queries ----------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    from compare import connect, differences

    assert differences(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == []


def test_whole_table_queries_by_brute_force(spark):
    given = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    got = {r.doc_id: r for r in queries.QUERIES["op8_repeats"](spark, SF).collect()}
    for doc_id, (n, left) in without_repeats(given, 100).items():
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (n, n - len(left), sha(left))
    got = queries.QUERIES["op10_ngram_jaccard"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked_components(given, 3, 90, 100)
