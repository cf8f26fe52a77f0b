import random

import pytest
from pyspark.sql import functions as F

from patch_model import changed_lines
from prsignal import schemas
from prsignal.operators import comments, features, label, metrics, sample, score
from prsignal.sources import sinks, tables

URL = "https://api.h/repos/o/r/pulls/{}"
HUNK = "@@ -70,3 +82,5 @@ def load():\n rows = []\n-skip = 1\n for r in read():\n+    check(r)\n     rows += r"
PATCH = """From c1 Mon Sep
diff --git a/x/a.py b/x/a.py
--- a/x/a.py
+++ b/x/a.py
@@ -10,9 +10,9 @@
+one
+two
 three
+four
+five
+six
@@ -50,2 +51,3 @@
-seven
+eight
+nine
"""


def resolved(spark, rows):
    """rows: (number, [(old, new)], [texts], [hunks], [paths], [commits], patch)."""
    return spark.createDataFrame(
        [
            (URL.format(n), f"p{n}.patch", (URL.format(n), f"p{n}.patch", pos, text, hunks, paths, commits), patch, "")
            for n, pos, text, hunks, paths, commits, patch in rows
        ],
        schemas.RESOLVED,
    )


def test_hunk_gives_its_changed_lines(spark):
    df = resolved(spark, [(1, [(4, 5)], ["why?"], [HUNK], ["app/io.py"], ["e1"], "")])
    for rows in (label.hunk_records(df).collect(), label.labelled_lines(df).collect()):
        old, new = sorted(rows, key=lambda r: r.line_at)
        assert (old.line_text, old.filename, old.is_added, old.commented, old.line) == ("skip = 1", "app/io.py", False, True, 71)
        assert (new.line_text, new.filename, new.is_added, new.commented, new.line) == ("    check(r)", "app/io.py", True, True, 72)
        assert new.previous_lines == ["rows = []", "skip = 1", "for r in read():", "    check(r)"]
        assert old.next_lines == ["skip = 1", "for r in read():", "    check(r)", "    rows += r"]
        assert (new.comment_text, new.commit_id, new.offset) == ("why?", None, None)
    (last,) = label.hunk_records(df.withColumn("parsed_input", F.col("parsed_input").withField(
        "diff_hunks", F.array(F.lit("@@ -1,1 +1,2 @@\n a\n+b\n")))), last_line_only=True).collect()
    assert last.line_text == "b"


def test_parallel_arrays_stop_at_the_shortest(spark):
    df = resolved(
        spark,
        [
            (1, [], ["a", "b"], [HUNK, HUNK, HUNK], ["x", "y", "z"], [], ""),
            (2, [], ["a"], None, ["x"], [], ""),
            (3, [], None, [HUNK], ["x"], [], ""),
        ],
    )
    got = label.comment_hunks(df).collect()
    assert [(r.item, r.path, r.comment_text) for r in got] == [(0, "x", "a"), (1, "y", "b")]


def test_hits_are_positive_neighbours_left_out_the_rest_negative(spark):
    # Position 4 is "four"; its neighbours 3 and 5 are " three" and "five".
    df = resolved(spark, [(1, [(None, 4)], [], [], ["x/a.py"], ["c1"], PATCH)])
    got = {r.line_text: r.commented for r in label.patch_records(df).collect()}
    assert got == {
        "one": False, "two": False, "four": True, "six": False, "seven": False, "eight": False, "nine": False,
    }
    assert {r.line_text: r.commented for r in label.labelled_lines(df).collect()} == got


def test_a_comment_on_another_commit_is_only_near(spark):
    df = resolved(spark, [(1, [(None, 4)], [], [], ["x/a.py"], ["c9"], PATCH)])
    got = {r.line_text: r.commented for r in label.patch_records(df).collect()}
    assert "four" not in got and "five" not in got and not any(got.values())
    assert label.labelled_lines(df).count() == 0  # nothing commented


def test_compat_reads_positions_as_line_numbers(spark):
    # "seven" is old line 50, "eight" new line 51, "nine" new line 52.
    df = resolved(spark, [(1, [(None, 52)], [], [], ["x/a.py"], ["c1"], PATCH)])
    got = {r.line_text: r.commented for r in label.patch_records(df, compat=True).collect()}
    assert got == {"eight": True}  # next to the hit "nine", which itself is left out
    df = resolved(spark, [(1, [(None, 900)], [], [], ["x/a.py"], ["c1"], PATCH)])
    assert label.patch_records(df, compat=True).count() == 0


def test_priority_per_text(spark):
    rows = [
        ("u", "same", True, "", 1, 0, 5),
        ("u", "same", True, "said", 0, 1, 3),
        ("u", "same", True, None, 0, 2, 1),
        ("u", "same", False, "", 1, 0, 1),
        ("u", "other", False, "", 1, 0, 7),
        ("u", "other", False, "", 1, 0, 6),
        ("v", "same", False, "", 1, 0, 1),
    ]
    df = spark.createDataFrame(
        rows,
        "pull_request_url string, line_text string, commented boolean, comment_text string, "
        "source int, item int, line_at int",
    )
    got = {(r.pull_request_url, r.line_text): (r.comment_text, r.line_at) for r in label.first_per_text(df).collect()}
    assert got == {("u", "same"): ("said", 3), ("u", "other"): ("", 6), ("v", "same"): ("", 1)}
    kept = label.with_commented_lines(df).select("pull_request_url").distinct().collect()
    assert [r[0] for r in kept] == ["u"]


def test_first_per_text_cuts_before_the_shuffle(spark):
    df = resolved(spark, [(1, [], [], [], [], [], PATCH)])
    plan = label.first_per_text(label.all_records(df))._jdf.queryExecution().executedPlan().toString()
    before, after = plan.index("WindowGroupLimit"), plan.rindex("WindowGroupLimit")
    assert before < plan.index("Exchange hashpartitioning(pull_request_url") < after


def random_rows(seed, n=40):
    rng = random.Random(seed)
    signs = ["+", "-", " "]
    out = []
    for k in range(n):
        lines = ["From c1 Mon", "diff --git a/f b/f", "@@ -10,5 +10,5 @@"]
        for i in range(rng.randint(1, 25)):
            lines.append(rng.choice(signs) + f"t{rng.randint(0, 12)}")
            if rng.random() < 0.1:
                lines.append("diff --git a/g b/g\n@@ -5,1 +6,1 @@")
            if rng.random() < 0.1:
                lines.append("@@ -90,1 +95,1 @@")
        m = rng.randint(0, 4)
        number = lambda: rng.choice([None, *range(-1, 20)])
        out.append(
            (
                k, [(number(), number()) for _ in range(m)], [rng.choice(["", "x", None]) for _ in range(m)],
                [HUNK if rng.random() < 0.3 else "@@ -1,2 +1,2 @@\n+t1" for _ in range(m)],
                [rng.choice(["f", "g", "h"]) for _ in range(m)],
                [rng.choice(["c1", "c2", None]) for _ in range(max(m - rng.randint(0, 1), 0))],
                "\n".join(lines),
            )
        )
    return out


def brute_force_patch_records(rows, compat):
    out = []
    for n, positions, _, _, paths, commits, patch in rows:
        for at, commit, old, new, position, _, text, _, file, _ in changed_lines(patch):
            triples = list(zip(commits, positions, paths))
            pairs = list(zip(positions, paths))
            if compat:
                hit = any(
                    c == commit and f == file and (p[1] == new or p[0] == old) for c, p, f in triples
                )
                spots = [new, old]
            else:
                hit = any(c == commit and f == file and position in p for c, p, f in triples)
                spots = [position]
            near = any(
                f == file and v is not None and any(abs(v - s) <= 1 for s in spots)
                for p, f in pairs
                for v in p
            )
            if compat and near and not hit:
                out.append((n, at, text, True))
            if not compat and (hit or not near):
                out.append((n, at, text, hit))
    return sorted(out)


@pytest.mark.parametrize("compat", [False, True])
def test_patch_records_against_brute_force(spark, compat):
    rows = random_rows(3)
    got = label.patch_records(resolved(spark, rows), compat).collect()
    got = sorted((int(r.pull_request_url.rsplit("/")[-1]), r.line_at, r.line_text, r.commented) for r in got)
    want = brute_force_patch_records(rows, compat)
    assert got == want and len(want) > (30 if compat else 200)


def shown(df, *without):
    columns = [c for c in label.LABELLED_COLUMNS if c not in without]
    return sorted(map(str, df.select(columns).collect()))


def test_comments_in_several_rows_give_the_same_labels(spark):
    df = resolved(spark, random_rows(4))
    whole = shown(label.labelled_lines(df), "item")
    assert len(whole) > 50
    # Hunks in one row, positions in the other.
    parsed = F.col("parsed_input")
    hunks = parsed.withField("comment_positions", F.slice(parsed["comment_positions"], 1, 0))
    positions = parsed.withField("diff_hunks", F.array().cast("array<string>"))
    rows = df.withColumn("parsed_input", positions).unionByName(df.withColumn("parsed_input", hunks))
    assert shown(label.labelled_lines(rows), "item") == whole
    # The whole and an older patch besides.
    empty = parsed.withField("comment_positions", F.slice(parsed["comment_positions"], 1, 0)).withField(
        "diff_hunks", F.array().cast("array<string>")
    )
    old = df.withColumn("parsed_input", empty).withColumns({"patch": F.lit("zzz"), "at": F.lit(1)})
    rows = df.withColumn("at", F.lit(2)).unionByName(old)
    assert shown(label.labelled_lines(rows, newest_by="at"), "item") == whole
    assert shown(label.labelled_lines(df.withColumn("at", F.lit(2)), newest_by="at"), "item") == whole


def test_places_move_and_not_the_records(spark, tmp_path, monkeypatch):
    df = resolved(spark, random_rows(6))
    # Rows repeated, and one without a url.
    df = df.unionByName(df.limit(5)).unionByName(df.limit(1).withColumn("pull_request_url", F.lit(None).cast("string")))
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    moved, materialize = [], label.materialize
    monkeypatch.setattr(label, "materialize", lambda kept: (moved.append(kept.columns), materialize(kept))[1])
    records = materialize(label.all_records(df))
    got = shown(label.labelled_lines(df))
    assert got == shown(label.with_commented_lines(label.first_per_text(records))) and len(got) > 50
    origin = ("source", "day", "item", "line_at")
    got = shown(label.distinct_records(df), *origin)
    assert got == shown(records.drop(*origin).distinct(), *origin) and len(got) > 50
    assert len(moved) == 2 and not any({"previous_lines", "next_lines"} & set(columns) for columns in moved)


def _scans_of_patches(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "FileScan" in line and "patch#" in line]


def test_patches_move_once(spark, tmp_path, monkeypatch):
    df = resolved(spark, random_rows(7))
    # Rows repeated, older patches, and rows without a url.
    df = df.unionByName(df.limit(5)).unionByName(df.limit(4).withColumn("patch", F.lit("a")))
    df = df.unionByName(df.limit(2).withColumn("pull_request_url", F.lit(None).cast("string")))
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    kept, materialize = [], label.materialize
    monkeypatch.setattr(label, "materialize", lambda texts: (kept.append(texts), materialize(texts))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        compat, got = label.patch_records(df, compat=True), label.labelled_lines(df)
        # The exchange of the patches is used again where the records are cut, and the table of texts is read then.
        assert [len(_scans_of_patches(x)) for x in (compat, *kept, got)] == [1, 1, 0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    newest = label.newest_patches(df)
    lines = label.flag_commented_lines(
        label.changed_lines(label.file_sections(newest.select("pull_request_url", "patch"))),
        label.comment_marks(df),
        compat=True,
    ).where("near AND NOT hit")
    columns = ["pull_request_url", "filename", "line_at", "previous_lines", "next_lines"]
    assert sorted(map(str, compat.select(columns).collect())) == sorted(map(str, lines.select(columns).collect()))
    assert lines.count() > 10 and newest.where("pull_request_url IS NULL").count() == 1
    want = label.with_commented_lines(label.first_per_text(materialize(label.all_records(df))))
    assert shown(got) == shown(want) and len(shown(got)) > 50


def test_two_rows_of_one_pull_request(spark):
    rows = [(1, [(None, n)], [], [], ["x/a.py"], ["c1"], PATCH) for n in (1, 5)]
    got = {r.line_text: r.commented for r in label.labelled_lines(resolved(spark, rows)).collect()}
    assert got == {"one": True, "five": True, "seven": False, "eight": False, "nine": False}


def test_clustered_comments_are_not_moved(spark, tmp_path):
    df = resolved(spark, random_rows(5))
    comments.attach_comments(spark, "clustered_for_test", str(tmp_path / "c"), 4)
    assert spark.table("clustered_for_test").count() == 0
    rows = comments.comments_of_rows(df)
    for half in (0, 1):
        comments.add_comments(rows.where(F.col("item") % 2 == half), "clustered_for_test")
    kept = spark.table("clustered_for_test")
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.select(kept.columns).collect()))
    got = label.labelled(label.newest_patches(df), kept)
    assert shown(got) == shown(label.labelled_lines(df).withColumn("item", F.col("item").cast("bigint")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = label.flagged_lines(df.select("pull_request_url", "patch"), kept)
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange, of the sections of the patches; the comments are read in buckets.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert "SortMergeJoin" in plan and "patch" not in plan.split("Bucketed: true")[1].split("\n")[0]


def test_only_the_folders_of_wanted_projects_are_read(spark, tmp_path):
    path = str(tmp_path / "facts")
    sinks.write_issue_facts(spark.createDataFrame(FACTS, schemas.ISSUE_FACT), path)
    lines = spark.createDataFrame(
        [("u", "x/a.py", 11, "o/s"), ("u", "x/a.py", 10, "o/s"), ("u", "x/a.py", 10, None)],
        "pull_request_url string, filename string, line int, project string",
    )
    lines.write.parquet(str(tmp_path / "lines"))
    lines, facts = spark.read.parquet(str(tmp_path / "lines")), tables.read_issue_facts(spark, path)
    marked = features.with_issue_marker(lines, facts, lines.select("project"))
    assert sorted((r.line, r.project or "", r.not_in_issues) for r in marked.collect()) == [
        (10, "", 1.0), (10, "o/s", 1.0), (11, "o/s", 0.0),
    ]
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(project" in plan


FACTS = [("o/r", "a.py", 10), ("o/r", "a.py", 10), ("o/s", "a.py", 11), ("o/s", "lib/a.py", 11)]


def labelled(spark):
    df = resolved(spark, [(1, [(None, 4)], [], [], ["x/a.py"], ["c1"], PATCH)])
    return label.labelled_lines(df)


def test_prepared_training(spark):
    facts = spark.createDataFrame(FACTS, schemas.ISSUE_FACT)
    rows = features.prepare_training_data(labelled(spark), facts, keep=("line",)).collect()
    assert len(rows) == 7
    for r in rows:
        assert (r.extension, r.label, r.commented) == ("py", float(r.line_text == "four"), r.label)
        assert r.line_length == len(r.line_text) and r.only_spaces == 0.0
        assert r.not_in_issues == (0.0 if r.line == 10 else 1.0)
    go_only = labelled(spark).withColumn("filename", F.lit("x/aa.go"))
    assert features.prepare_training_data(go_only, facts).count() == 0
    assert features.prepare_training_data(go_only, facts, py_only=False).count() == 7


def test_compat_fan_out(spark):
    facts = spark.createDataFrame(FACTS, schemas.ISSUE_FACT)
    lines = spark.createDataFrame(
        [("u", "f/a.py", 10), ("u", "f/a.py", 11), ("u", "f/b.py", 11)],
        "pull_request_url string, filename string, line int",
    )
    got = features.with_issue_fan_out(lines, facts).select("filename", "line", "not_in_issues", "copies").collect()
    assert sorted(tuple(r) for r in got) == [("f/a.py", 10, 0.0, 2), ("f/a.py", 11, 0.0, 2), ("f/b.py", 11, 1.0, 1)]


def test_split_keeps_pull_requests_whole(spark):
    df = spark.range(3000).select(F.concat(F.lit("u"), F.col("id") % 300).alias("pull_request_url"), "id")
    train, test = sample.split_by_key(df.repartition(5))
    a = {r[0] for r in train.select("pull_request_url").collect()}
    b = {r[0] for r in test.select("pull_request_url").collect()}
    assert not a & b and len(a | b) == 300 and 10 < len(b) < 60
    assert train.count() + test.count() == 3000


@pytest.mark.parametrize("positives, total", [(1, 10), (3, 10), (5, 10), (10, 10)])
def test_balance(spark, positives, total):
    df = spark.range(total).select("id", (F.col("id") < positives).cast("double").alias("label"))
    counts = dict(sample.balance_classes(df).groupBy("label").count().collect())
    assert counts.get(1.0) == positives * -(-total // positives)
    assert counts.get(0.0, 0) == total - positives
    by_negatives = dict(sample.balance_classes(df, "negatives").groupBy("label").count().collect())
    assert by_negatives[1.0] == positives * max(1, -(-(total - positives) // positives))


def test_copies_count_as_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 3), (2, 0.0, 4), (3, 0.0, 5)], "id int, label double, copies bigint")
    rows = df.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy", "copies")
    assert tuple(sample.summarize(df).first()) == tuple(sample.summarize(rows).first()) == (12, 3)
    for basis in ("total", "negatives"):
        want = dict(sample.balance_classes(rows, basis).groupBy("id").count().collect())
        got = {r.id: r.weight for r in sample.weigh_classes(df, basis).collect()}
        assert got == {k: float(n) for k, n in want.items()}


def test_balance_refuses_without_positives(spark):
    df = spark.range(5).select(F.lit(0.0).alias("label"))
    with pytest.raises(Exception, match="no positive examples"):
        sample.balance_classes(df).collect()
    assert tuple(sample.summarize(df).first()) == (5, 0)


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "pull_request_url string, filename string, offset int, commit_id string, p1 double, prediction double"
    )


def test_top_seven(spark):
    rows = [("u", "f", i, "c", 0.5 + i / 100, 1.0) for i in range(12)]
    rows += [("u", "f", 3, "c", 0.9, 1.0), ("u", "f", 50, "c", 0.2, 0.0), ("u", "f", 51, None, 0.99, 1.0)]
    rows += [("v", "f", 1, "c", 0.6, 1.0)] * 3
    got = score.suggest(scored(spark, rows)).orderBy("pull_request_url", "rank").collect()
    assert [(r.pull_request_url, r.line) for r in got] == [
        ("u", 3), ("u", 11), ("u", 10), ("u", 9), ("u", 8), ("u", 7), ("u", 6), ("v", 1),
    ]
    _, unplaced = score.split_unplaced(score.best_per_line(score.positive_only(scored(spark, rows))))
    assert [r.line for r in unplaced.collect()] == [51]


def test_responses_keep_failed_requests(spark):
    requests = spark.createDataFrame([("u",), ("v",), ("w",)], "pull_request_url string")
    suggestions = score.suggest(scored(spark, [("u", "f", 1, "c", 0.6, 1.0), ("u", "f", 2, "c", 0.7, 1.0)]))
    errors = spark.createDataFrame([("w", "no text")], "pull_request_url string, error string")
    got = {r.pull_request_url: r for r in score.responses(requests, suggestions, errors).collect()}
    assert [(p.commit_id, p.position) for p in got["u"].positions] == [("c", 2), ("c", 1)]
    assert (got["v"].positions, got["v"].message) == ([], None)
    assert (got["w"].positions, got["w"].message) == ([], "no text")


def test_dedupe_compares_fields_not_their_concatenation(spark):
    df = spark.createDataFrame(
        [("u", "c", "f1", 2), ("u", "c", "f", 12), ("u", "c", "f", 12)],
        "pull_request_url string, commit_id string, filename string, line int",
    )
    assert score.dedupe_suggestions(df).count() == 2


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_areas_match_the_evaluator(spark, ranges):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(ranges)
    rows = [(round(rng.random() ** 3, 2), float(rng.random() < 0.3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "p1 double, label double").repartition(5)
    points = metrics.curve_points(df, ranges=ranges).collect()
    assert max(p.tp + p.fp for p in points) == 3000
    got = metrics.areas(df).first()
    for name, metric in (("pr", "areaUnderPR"), ("roc", "areaUnderROC")):
        evaluator = BinaryClassificationEvaluator(rawPredictionCol="p1", metricName=metric, numBins=0)
        assert got[name] == pytest.approx(evaluator.evaluate(df), abs=1e-9)


def test_areas_without_a_class(spark):
    df = spark.createDataFrame([(0.5, 0.0)], "p1 double, label double")
    assert metrics.areas(df).first().roc is None and metrics.areas(df).first().pr is None
