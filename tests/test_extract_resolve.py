import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from prsignal import schemas
from prsignal.operators import extract, resolve
from prsignal.operators.clean import clean_comments
from prsignal.plans import jobs
from prsignal.sources import sinks, tables


def event(i, kind="PullRequestReviewCommentEvent", url="https://api.h/repos/o/r/pulls/1", **comment):
    payload = {
        "action": "opened",
        "pull_request": {"url": url, "patch_url": "https://h/o/r/pull/1.patch"},
        "comment": comment,
        "issue": {"url": f"https://h/issues/{i}"},
    }
    return (i, kind, ("o/r",), json.dumps(payload), "20240101")


def events(spark, rows):
    return spark.createDataFrame(rows, schemas.ARCHIVE_EVENT)


def test_comments_stay_aligned(spark):
    rows = [
        event(3, position=7, original_position=8, commit_id="c3", path="b.py", body="x"),
        event(1, position=None, original_position=2, commit_id="c1", path=None, body="y"),
        event(2, kind="PushEvent", position=9),
        (4, "PullRequestEvent2", ("o/r",), "{oops", "20240101"),
        (5, "PullRequestEvent2", ("o/r",), None, "20240101"),
        event(6, url=None, position=1),
    ]
    comments = extract.review_comments(events(spark, rows))
    row = extract.comments_by_pull_request(comments).first()
    assert (row.comments_positions, row.comments_original_positions) == (["-1", "7"], ["2", "8"])
    assert (row.comment_commit_ids, row.comment_file_paths) == (["c1", "c3"], [None, "b.py"])
    cell = extract.comment_cells(extract.comments_by_pull_request(comments)).first()
    assert cell.comment_file_paths_json_encoded == '["b.py"]'
    assert cell.comments_positions_space_delimited == "-1 7"
    ok, bad = extract.split_undecodable(events(spark, rows))
    assert sorted(r.event_id for r in bad.collect()) == [4, 5]
    assert sorted(r.event_id for r in ok.collect()) == [1, 2, 3, 6]


def test_no_paths_give_null_text(spark):
    comments = extract.review_comments(events(spark, [event(1, commit_id="c")]))
    cell = extract.comment_cells(extract.comments_by_pull_request(comments)).first()
    assert cell.comment_file_paths_json_encoded == "null"


def test_a_hot_pull_request_takes_several_rows_and_loses_nothing(spark):
    rows = [event(i, position=i, commit_id=f"c{i}", path="a.py") for i in range(900)]
    rows += [event(1000 + i, url=f"https://api.h/repos/o/r/pulls/{i}x", position=i) for i in range(20)]
    comments = extract.review_comments(events(spark, rows))
    grouped = extract.comments_by_pull_request(comments, max_comments=100)
    sizes = [
        (r.pull_request_url, len(r.comments_positions), len(r.comment_commit_ids))
        for r in grouped.collect()
    ]
    hot = [n for url, n, _ in sizes if url.endswith("/1")]
    assert len(hot) == 9 and sum(hot) == 900 and max(hot) < 200
    assert all(n == 1 for url, n, _ in sizes if url.endswith("x"))
    everything = [p for r in grouped.collect() for p in r.comments_positions]
    assert sorted(map(int, everything)) == sorted([*range(900), *range(20)])


def test_comments_are_shuffled_once(spark):
    grouped = extract.comments_by_pull_request(extract.review_comments(events(spark, [event(1)])))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_opened_issues(spark):
    rows = [event(1, kind="IssuesEvent"), event(2), event(3, kind="IssuesEvent")]
    closed = list(event(4, kind="IssuesEvent"))
    closed[3] = closed[3].replace('"opened"', '"closed"')
    found = extract.opened_issues(events(spark, [*rows, tuple(closed)]))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("o/r", "https://h/issues/1"),
        ("o/r", "https://h/issues/3"),
    ]


def test_limit(spark):
    cells = spark.range(50).withColumnRenamed("id", "k")
    assert [r.k for r in extract.limit_cells(cells, 3, ["k"]).collect()] == [0, 1, 2]
    assert extract.limit_cells(cells, -1).count() == 50


def cleaned(spark, numbers):
    raw = [
        {
            "pull_request_url": f'"https://api.h/repos/o/r/pulls/{i}"',
            "pull_patch_url": f'"https://h/o/r/pull/{i}.patch"',
            "comment_positions": [{"original_position": "1", "new_position": "1"}],
            "comment_text": ["t"],
            "diff_hunks": [r'"@@ -1,1 +1,2 @@\n+a"'],
            "comment_commit_ids": ['"c"'],
            "comment_file_paths": ['"a.py"'],
        }
        for i in numbers
    ]
    return clean_comments(
        tables.comments_from_json(spark.createDataFrame([(json.dumps(raw),)], "value string"))
    )


def pages(spark, numbers, status=200):
    rows = [
        (f"https://h/o/r/pull/{i}.{end}", status, f"{end} of {i}") for i in numbers for end in ("patch", "diff")
    ]
    return spark.createDataFrame(rows, schemas.RESPONSE)


def test_cached_inputs_are_left_out(spark):
    cache = spark.createDataFrame(
        [("https://api.h/repos/o/r/pulls/7", "not real", "not real")], schemas.STORED_PATCH
    )
    assert resolve.resolve_patches(cleaned(spark, [7]), cache, pages(spark, [7])).count() == 0


def test_anti_join_against_sets(spark):
    rng = random.Random(5)
    numbers = [rng.randint(0, 40) for _ in range(60)]
    cached = {rng.randint(0, 40) for _ in range(15)}
    inputs = spark.createDataFrame([(f"u{i}",) for i in numbers], "pull_request_url string")
    cache = spark.createDataFrame([(f"u{i}", "", "") for i in cached], schemas.STORED_PATCH)
    got = sorted(r.pull_request_url for r in resolve.not_cached(inputs, cache).collect())
    assert got == sorted(f"u{i}" for i in numbers if i not in cached)


def test_both_pages_must_be_found(spark):
    responses = pages(spark, [1, 2, 3]).withColumn(
        "status",
        F.when(F.col("url").endswith("2.diff"), 404).when(F.col("url").endswith("3.patch"), 500).otherwise(200),
    )
    empty = tables.read_cache(spark, None)
    got = resolve.resolve_patches(cleaned(spark, [1, 2, 3, 4]), empty, responses).collect()
    assert [(r.pull_request_url[-1], r.patch, r.diff) for r in got] == [("1", "patch of 1", "diff of 1")]
    assert got[0].parsed_input.diff_hunks == ["@@ -1,1 +1,2 @@\n+a"]


def test_bodies_are_shuffled_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = resolve.resolve_patches(cleaned(spark, [1]), tables.read_cache(spark, None), pages(spark, [1]))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 5  # two of them for the anti join
    assert sum(plan.count(f"Exchange hashpartitioning({k}") for k in ("stem", "patch_stem", "diff_stem")) == 3


def test_urls_with_other_endings(spark):
    inputs = cleaned(spark, [1, 2]).withColumn(
        "pull_patch_url", F.regexp_replace("pull_patch_url", "1.patch$", "1.other")
    )
    rows = [("https://h/o/r/pull/1.other", 200, "p"), ("https://h/o/r/pull/1.diff", 200, "d"),
            ("https://h/o/r/pull/2.other", 200, "p"), ("https://h/o/r/pull/2.diff", 200, "d")]
    responses = spark.createDataFrame(rows, schemas.RESPONSE)
    got = resolve.resolve_patches(inputs, tables.read_cache(spark, None), responses).collect()
    assert [(r.pull_patch_url, r.patch, r.diff) for r in got] == [("https://h/o/r/pull/1.other", "p", "d")]


def test_ingest_twice_with_cache_adds_nothing(spark, tmp_path):
    raw, out, cache = (str(tmp_path / n) for n in ("raw", "out", "cache"))
    rows = spark.createDataFrame(
        [
            (
                '"https://h/o/r/pull/1.patch"', "2024", '"https://api.h/repos/o/r/pulls/1"', [], ["t"],
                ['"@@"'], ['"c"'], ['"a"'],
            )
        ],
        schemas.RAW_COMMENTS,
    )
    rows.write.parquet(raw)
    for _ in range(2):
        jobs.ingest_comments(spark, raw, pages(spark, [1]), out, cache)
    assert tables.read_resolved(spark, out).count() == 1
    assert tables.read_cache(spark, cache).count() == 1
    jobs.ingest_comments(spark, raw, pages(spark, [1]), out)  # without a cache
    assert tables.read_resolved(spark, out).count() == 1
    # A late comment on the cached pull request, whose page is gone by now.
    late = rows.withColumn("comment_text", F.array(F.lit("late")))
    late.write.mode("append").parquet(raw)
    for _ in range(2):
        jobs.ingest_comments(spark, raw, pages(spark, []), out, cache)
    got = tables.read_resolved(spark, out).collect()
    assert sorted((r.parsed_input.comment_text[0], r.patch) for r in got) == [("late", "patch of 1"), ("t", "patch of 1")]
    assert tables.read_cache(spark, cache).count() == 1


def test_an_ingest_reads_no_text_that_it_need_not(spark, tmp_path):
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    resolve.fetch_and_store(cleaned(spark, [1, 2]), tables.read_cache(spark, cache), pages(spark, [1, 2]), out, cache)
    unread = pages(spark, [1, 2]).withColumn("body", F.raise_error(F.lit("read")).cast("string"))
    late = cleaned(spark, [2]).withColumn("comment_text", F.array(F.lit("late")))
    for rows in (cleaned(spark, [1, 2]), late.unionByName(cleaned(spark, [1, 2, 2]))):
        resolve.fetch_and_store(rows, tables.read_cache(spark, cache), unread, out, cache)
    assert sorted(r.pull_request_url[-1] for r in tables.read_resolved(spark, out).collect()) == ["1", "2", "2"]
    assert tables.read_cache(spark, cache).count() == 2


def test_an_ingest_of_repeated_rows_and_pages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    stored, kept = set(), set()
    for _ in range(4):
        rows = [(f"u{rng.randint(0, 5)}", rng.randint(0, 5), rng.choice("abc")) for _ in range(12)]
        rows += [(None, 1, "a"), ("u1", None, "a")]
        found = [n for n in range(6) if rng.random() < 0.6]
        inputs = spark.createDataFrame(
            [(u, None if n is None else f"https://h/o/r/pull/{n}.patch", [], [t], [], [], []) for u, n, t in rows],
            schemas.CLEAN_COMMENTS,
        )
        answers = pages(spark, found + found[:2]) if found else pages(spark, [])
        resolve.fetch_and_store(inputs, tables.read_cache(spark, cache), answers, out, cache)
        cached = set(kept)
        for u, n, t in set(rows):
            # A row without a pull request is in no table that it could be looked up in.
            if u in cached:
                stored.add((u, n, t))
            elif n in found and u:
                stored.add((u, n, t))
                kept.add(u)
    resolved = tables.read_resolved(spark, out).collect()
    got = [(r.pull_request_url, r.pull_patch_url, r.parsed_input.comment_text[0]) for r in resolved]
    with_url = [(u, int(p[-7]) if p else None, t) for u, p, t in got if u]
    assert len(with_url) == len(set(with_url)) and set(with_url) == stored
    in_cache = tables.read_cache(spark, cache).where("pull_request_url IS NOT NULL").collect()
    assert sorted(r.pull_request_url for r in in_cache) == sorted(kept)


def test_intermediate_tables_go_when_the_work_is_done(spark, tmp_path):
    from pathlib import Path

    from prsignal.session import checkpoint_dir, materialize, scratch

    def tables_there():
        folder = Path(checkpoint_dir(spark).removeprefix("file:"))
        return set(folder.glob("table-*")) if folder.exists() else set()

    before = tables_there()
    with scratch(spark):
        materialize(spark.range(3))
        assert len(tables_there() - before) == 1
    assert tables_there() == before
    with pytest.raises(RuntimeError), scratch(spark):
        materialize(spark.range(3))
        raise RuntimeError
    assert tables_there() == before
    assert materialize(spark.range(3)).count() == 3 and len(tables_there() - before) == 1


@pytest.mark.parametrize("master, named, works", [
    ("local[4]", None, True), ("local-cluster[2,1,1024]", None, False), ("yarn", None, False), ("yarn", "s3://x/", True),
])
def test_a_cluster_has_to_name_a_shared_folder(master, named, works):
    from types import SimpleNamespace

    from prsignal.session import checkpoint_dir

    settings = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": "file:/w"}
    conf = SimpleNamespace(get=lambda name, default=None: settings.get(name) or default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    if works:
        assert checkpoint_dir(session) == ("s3://x" if named else "file:/w/_work")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session)


def test_the_older_ingest_loses_late_comments(spark, tmp_path):
    out, cache = str(tmp_path / "out"), str(tmp_path / "cache")
    for numbers in ([1], [1, 2]):
        rows = cleaned(spark, numbers)
        resolve.fetch_and_store(rows, tables.read_cache(spark, cache), pages(spark, [1, 2]), out, cache, compat=True)
    resolve.fetch_and_store(
        cleaned(spark, [1]).withColumn("comment_text", F.array(F.lit("late"))),
        tables.read_cache(spark, cache), pages(spark, [1]), out, cache, compat=True,
    )
    assert sorted(r.pull_request_url[-1] for r in tables.read_resolved(spark, out).collect()) == ["1", "2"]


def test_failures_are_rows_and_are_asked_for_again(spark):
    def fetch(url):
        import time

        time.sleep(random.random() / 200)
        if url.endswith("3"):
            raise OSError(f"no {url}")
        return 200, url.upper()

    urls = spark.createDataFrame([(f"u{i}",) for i in range(100)], "url string").repartition(3)
    for in_flight in (0, 1, 8):
        got = {r.url: r for r in resolve.fetch_responses(urls, fetch, in_flight).collect()}
        assert len(got) == 100
        for i in range(100):
            r = got[f"u{i}"]
            want = (None, None, f"OSError: no u{i}") if i % 10 == 3 else (200, f"U{i}", None)
            assert (r.status, r.body, r.error) == want
    first = resolve.fetch_responses(urls.where("url != 'u50'"), fetch)
    again = resolve.wanted_again(urls, first).collect()
    assert sorted(r.url for r in again) == sorted(["u50", *(f"u{i}" for i in range(3, 100, 10))])


def test_answers_come_as_they_are_ready_within_the_window():
    taken, open_now, most = [], [0], [0]
    lock, slow = threading.Lock(), threading.Event()

    def items():
        for i in range(40):
            taken.append(i)
            yield i

    def call(i):
        with lock:
            open_now[0] += 1
            most[0] = max(most[0], open_now[0])
        if i == 0:
            slow.wait(20)
        with lock:
            open_now[0] -= 1
        return i * i

    got = []
    for i, result, error in resolve.in_completion_order(items(), call, 4):
        got.append(i)
        assert (result, error) == (i * i, None)
        # Taken are those that came back, those in flight, and no more.
        assert len(taken) <= len(got) + 2 * 4
        if len(got) == 30:
            slow.set()
    assert sorted(got) == list(range(40)) and got.index(0) >= 29 and most[0] <= 4
    assert [i for i, *_ in resolve.in_completion_order(range(5), call, 0)] == list(range(5))
    assert list(resolve.in_completion_order([], call, 3)) == []


def test_resolve_and_mine_issues(spark, tmp_path):
    inputs = spark.createDataFrame([("o/r", '""https://h/i/1"'), ("o/s", "https://h/i/2")], schemas.ISSUE_INPUT)
    inputs.write.parquet(str(tmp_path / "in"))
    responses = spark.createDataFrame(
        [("https://h/i/1", 200, " at f(a.py:3) \n at f(a.py:3)"), ("https://h/i/2", 404, " x.py:1")],
        schemas.RESPONSE,
    )
    jobs.mine_issues(spark, str(tmp_path / "in"), responses, str(tmp_path / "facts"))
    facts = tables.read_issue_facts(spark, str(tmp_path / "facts")).collect()
    assert [(r.project, r.filename, r.line) for r in facts] == [("o/r", "a.py", 3)]


def test_daily_extract_job(spark, tmp_path):
    path, out = str(tmp_path / "archive"), str(tmp_path / "daily")
    rows = [
        (i, *event(i, position=i, commit_id="c", path="a.py", diff_hunk="@@ -1,1 +1,1 @@\n+a", body="t")[1:4], day)
        for i, day in enumerate(["20240101", "20240101", "20240102"])
    ]
    events(spark, rows).write.partitionBy("day").parquet(path)
    assert jobs.extract_comments(spark, path, ["20240101", "20240102"], out) == ["20240101", "20240102"]
    assert jobs.extract_comments(spark, path, ["20240101", "20240102"], out) == []
    back = spark.read.schema(schemas.COMMENT).parquet(out)
    assert sorted((r.day, r.item, r.new_position, r.filename, r.has_commit) for r in back.collect()) == [
        ("20240101", 0, 0, "a.py", True), ("20240101", 1, 1, "a.py", True), ("20240102", 2, 2, "a.py", True),
    ]
    assert {r.hunk for r in back.collect()} == {"@@ -1,1 +1,1 @@\n+a"}
    requested = str(tmp_path / "requested")
    for days in (["20240102", "20240103"], ["20240103", "20240104"]):
        spark.createDataFrame([(d,) for d in days], "value string").write.mode("append").text(requested)
        jobs.follow_days(spark, path, requested, out, str(tmp_path / "state"))
    ledger = sorted(tuple(r) for r in sinks.read_ledger(spark, out).collect())
    assert ledger == [("20240101", 2, ""), ("20240102", 1, ""), ("20240103", 0, "0"), ("20240104", 0, "1")]
    clustered = jobs.label_store(spark, out, ["20240101"], "daily_comments", str(tmp_path / "clustered"), 3)
    assert clustered.count() == 2


def test_hunks_of_the_fixture_split_a_text_once(spark, tmp_path):
    from prsignal.plans import fixtures

    texts = {1: "a\nb\nc\nd\ne", 2: "", 3: "one", 6: "x\n\ny", 7: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in texts], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for row in fixtures.resolved(spark, str(tmp_path)).select("pull_request_url", "parsed_input.diff_hunks").collect():
        i = int(row.pull_request_url.rsplit("/", 1)[1])
        n = 1 + i % 4
        if texts[i] is None:
            assert row.diff_hunks == [None] * n
            continue
        lines = texts[i].split("\n")
        parts = [[] for _ in range(n)]
        for at, line in enumerate(lines):
            parts[at * n // len(lines)].append(" +-"[(i + at) % 3] + line)
        assert row.diff_hunks == ["@@ -5,4 +5,6 @@ x\n" + "\n".join(part) for part in parts]
    assert fixtures.HUNKS.count("split(text") == 1
