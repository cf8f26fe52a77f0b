import random

from pyspark.sql import functions as F

from patch_model import changed_lines
from prsignal.operators import patch as P

MAIL = """
From 9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c Tue Feb 03 09:00:00 2026
From: dev <dev@example.org>
Subject: [PATCH] keep tables small

---
 docs/tables.txt | 1 +

diff --git a/docs/tables.txt b/docs/tables.txt
index 1010101..2020202 100644
--- a/docs/tables.txt
+++ b/docs/tables.txt
@@ -11,6 +11,7 @@ Tables
 alpha
 beta
 gamma
+delta
 epsilon
 # end
 # more
diff --git a/src/load.py b/src/load.py
index 3030303..4040404 100644
--- a/src/load.py
+++ b/src/load.py
@@ -80,6 +81,8 @@ import io
 
 # comment
 def load(path):
-    rows = read()
+    rows = read(path)
+    rows = rows[1:]
     check(rows)
+    log(rows)
     return rows
"""

DIFF = """
diff --git a/job.sh b/job.sh
index 5050505..6060606 100755
--- a/jobs/job.sh
+++ b/jobs/job.sh
@@ -20,4 +20,4 @@ start
 x
 y
-run one
+run two
 z
diff --git a/env.txt b/env.txt
--- a/env.txt
+++ b/env.txt
@@ -3,3 +4,3 @@ x
 a
-b
+c
 d
"""


def rows(df):
    return [
        (
            r.line_at, r.commit_id, r.old_pos, r.new_pos, r.position, tuple(r.previous_lines),
            r.text, tuple(r.next_lines), r.filename, r.is_added,
        )
        for r in df.orderBy("line_at").collect()
    ]


def parse(spark, text, **options):
    df = spark.createDataFrame([("p", text)], "patch_id string, patch string")
    return rows(P.parse_patches(df, **options))


def test_mail_patch(spark):
    got = parse(spark, MAIL, next_lines=3)
    assert [(g[8], g[2], g[3], g[4], g[9]) for g in got] == [
        ("docs/tables.txt", 13, 14, 4, True),
        ("src/load.py", 83, 83, 4, False),
        ("src/load.py", 83, 84, 5, True),
        ("src/load.py", 83, 85, 6, True),
        ("src/load.py", 84, 87, 8, True),
    ]
    assert {g[1] for g in got} == {"9f8e7d6c5b4a39281706f5e4d3c2b1a09f8e7d6c"}
    assert got[0][5:8] == (
        ("alpha", "beta", "gamma", "delta"), "delta", ("delta", "epsilon", "# end"),
    )
    assert got[1][5] == ("", "# comment", "def load(path):", "    rows = read()")


def test_plain_diff_takes_the_name_of_the_plus_line(spark):
    got = parse(spark, DIFF)
    assert [(g[1], g[2], g[3], g[4], g[8], g[9]) for g in got] == [
        (None, 22, 21, 3, "jobs/job.sh", False),
        (None, 22, 22, 4, "jobs/job.sh", True),
        (None, 4, 4, 2, "env.txt", False),
        (None, 4, 5, 3, "env.txt", True),
    ]


def test_hunk_mode(spark):
    hunk = "@@ -70,6 +72,7 @@ class Store\n class Row:\n     id = 0\n     name = 1\n+    size = 2\n     tags = 3\n     note = 4\n     last = 5"
    got = parse(spark, hunk, hunk_mode=True)
    assert got == [
        (4, None, 72, 75, 5, ("class Row:", "    id = 0", "    name = 1", "    size = 2"), "    size = 2",
         ("    size = 2", "    tags = 3", "    note = 4", "    last = 5"), None, True)
    ]
    assert parse(spark, hunk) == []


def random_patch(rng):
    parts = [
        "diff --git a/x.py b/x.py", "diff --git a/a b/c b/d.go", "--- a/x.py", "+++ b/y/x.py ",
        "+++ b/z.md", "@@ -1,3 +4,5 @@ f", "@@ -10,0 +20,1 @@", "@@ -1 +1 @@",
        "From abc123 Mon Sep", "From what I see", "From: me", "index 1..2 100644", "+", "-", " ",
        "", "+added", "-removed", " context", "\ttab", "+cr\r", "\r", "-- ", "--- a/", "---", "+++ b/",
        "\\ No newline at end of file", "+sep\u2028x", "-nel\x85", " From abc x", "new file mode 100644",
        "+" + "y" * 1999, "-" + "z" * 2000, "@@ -7,2 +9,9 @@\r", "From x\r",
    ]
    heavy = ["diff --git a/x.py b/x.py", "@@ -1,3 +4,5 @@ f", "+added", "-removed", " context"]
    return "\n".join(rng.choice(parts + heavy * 3) for _ in range(rng.randint(0, 40)))


def expected(texts, **options):
    out, errors = [], []
    for i, text in enumerate(texts):
        try:
            out += [(i, *r) for r in list(changed_lines(text, **options))]
        except TypeError:  # a header after a commit line in hunk mode
            errors.append(i)
    return sorted(out, key=lambda r: r[:2]), errors


def check_random(spark, hunk_mode):
    rng = random.Random(7)
    texts = [random_patch(rng) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "patch_id int, patch string")
    df = df.repartition(8)
    got = P.parse_patches(df, hunk_mode=hunk_mode).collect()
    got = sorted(
        (
            r.patch_id, r.line_at, r.commit_id, r.old_pos, r.new_pos, r.position,
            tuple(r.previous_lines), r.text, tuple(r.next_lines), r.filename, r.is_added,
        )
        for r in got
    )
    want, errors = expected(texts, hunk_mode=hunk_mode)
    assert len(got) == len(want) > 1000
    for g, w in zip(got, want):
        assert g == w
    bad = P.split_rejects(df, hunk_mode=hunk_mode)[1]
    assert sorted(r.patch_id for r in bad.collect()) == errors


def test_random_patches(spark):
    check_random(spark, False)


def test_random_hunks(spark):
    check_random(spark, True)


def test_long_lines_are_kept_unless_a_length_is_given(spark):
    text = "diff --git a/x b/x\n@@ -1,1 +1,1 @@\n+" + "y" * 1999 + "\n-" + "z" * 2000 + "\n+" + "w" * 1_000_000
    assert [len(g[6]) for g in parse(spark, text)] == [1999, 2000, 1_000_000]
    assert [len(g[6]) for g in parse(spark, text, max_length=P.DESCRIBED_MAX_LENGTH)] == [1999]
    assert [len(r[6]) for r in changed_lines(text, max_length=2000)] == [1999]


def test_rejects(spark):
    big = "99999999999"
    patches = [
        ("null", None),
        ("ok", f"@@ -{big},1 +1,1 @@\n+a"),  # no diff command: the header does not count
        ("over", f"diff --git a/x b/x\n@@ -{big},1 +1,1 @@\n+a"),
        ("reset", f"diff --git a/x b/x\nFrom abc Mon\n@@ -{big},1 +1,1 @@\n+a"),
    ]
    df = spark.createDataFrame(patches, "patch_id string, patch string")
    ok, bad = P.split_rejects(df)
    assert {r.patch_id for r in bad.collect()} == {"null", "over"}
    assert {r.patch_id for r in ok.collect()} == {"ok", "reset"}
    assert P.rejected_patches(df).columns == ["patch", "error"]
    assert P.parse_patches(df).count() == 0


def test_line_numbers_wrap_like_an_int(spark):
    got = parse(spark, "diff --git a/x b/x\n@@ -2147483647,1 +2147483647,9 @@\n+a\n+b")
    assert [(g[2], g[3]) for g in got] == [(2147483646, 2147483647), (2147483646, -2147483648)]


def test_strict_mode(spark):
    text = "From abc Mon\ndiff --git a/x b/x\n@@ -1 +1 @@\n-a\r\n+b\r\n-- \n2.30\n"
    assert parse(spark, text) == []
    assert [(g[6], g[4]) for g in parse(spark, text, strict=True)] == [("a", 1), ("b", 2)]


def test_no_exchange_and_duplicate_ids(spark):
    df = spark.createDataFrame([("p", MAIL), ("p", MAIL), ("p", DIFF)], "patch_id string, patch string")
    parsed = P.parse_patches(df)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # A text is split once; the check for rejects uses the same lines.
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("split(patch") == 1
    assert parsed.count() == 5 + 5 + 4


def test_marks(spark):
    df = spark.createDataFrame([("p", MAIL)], "patch_id string, patch string")
    sections = P.file_sections(df).withColumn("wanted", F.array(F.lit(5), F.lit(8), F.lit(99), F.lit(-3)))
    got = P.changed_lines(sections, marks={"hit": "wanted"}).orderBy("line_at").collect()
    assert [r.hit for r in got] == [False, False, True, False, True]
