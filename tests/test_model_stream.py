import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from prsignal import schemas
from prsignal.operators import model as M
from prsignal.operators.sample import balance_classes, weigh_classes
from prsignal.plans import jobs
from prsignal.sources import tables
from prsignal.streaming import events as S

SMALL = {"prep_options": {"n_hashes": 64, "min_doc_freq": 1}, "classifier_options": {"maxIter": 2, "maxDepth": 2}}


def prepared(spark, n=240):
    return spark.range(n).selectExpr(
        "CAST(id AS INT) AS id",
        "concat('u', id % 30) AS pull_request_url",
        "array('a') AS previous_lines",
        "CASE WHEN id % 4 = 0 THEN concat('if broken', id % 7) ELSE concat('x = ', id % 5, ' + y') END AS line_text",
        "array('b') AS next_lines",
        "'x/ab.py' AS filename",
        "true AS is_added",
        "CAST(id % 4 = 0 AS DOUBLE) AS commented",
        "CASE WHEN id % 3 = 0 THEN 'go' ELSE 'py' END AS extension",
        "CAST(10 + id % 5 AS DOUBLE) AS line_length",
        "CAST(id % 4 = 0 AS DOUBLE) AS label",
        "0.0D AS only_spaces",
        "CAST(id % 2 AS DOUBLE) AS not_in_issues",
        "'c' AS commit_id",
        "CAST(id AS INT) AS offset",
    )


def test_prep_models_are_kept_by_rows_and_options(spark, tmp_path):
    store = str(tmp_path / "prep")
    rows = prepared(spark)
    first = M.load_or_fit_prep(rows, store, n_hashes=16)
    path = M.prep_address(rows.repartition(3), store, n_hashes=16)
    assert M.path_exists(spark, path) and path == M.prep_address(rows, store, n_hashes=16)
    other = rows.withColumn("line_text", F.lit("something else entirely"))
    assert M.prep_address(other, store, n_hashes=16) != path != M.prep_address(rows, store, n_hashes=17)
    again = M.load_or_fit_prep(rows, store, n_hashes=16)
    assert again.stages[3].docFreq == first.stages[3].docFreq
    assert M.load_or_fit_prep(other, store, n_hashes=16).stages[3].docFreq != first.stages[3].docFreq
    # One folder a model and nothing left aside.
    assert len(list((tmp_path / "prep").iterdir())) == 2


def test_word_vectors_and_term_frequencies(spark):
    for options, size in (({"word_vectors": True, "vector_size": 4, "min_count": 1}, 8), ({"n_hashes": 16}, 20)):
        model = M.fit_prep(prepared(spark), **options)
        rows = prepared(spark).unionByName(prepared(spark, 1).withColumn("extension", F.lit("unseen")))
        out = model.transform(rows)
        assert out.count() == 240  # an unseen extension is skipped
        assert out.first().features.size == size


def test_word_vectors_are_fitted_on_a_bounded_sample(spark):
    rows = spark.range(5000).selectExpr("concat('x', id) AS line_text")
    assert M.sample_of_rows(rows, "line_text", 5000).count() == 5000
    some = M.sample_of_rows(rows, "line_text", 500)
    assert 300 < some.count() < 700
    assert some.exceptAll(M.sample_of_rows(rows.repartition(7), "line_text", 500)).isEmpty()


def test_word_vectors_are_fitted_on_all_rows(spark):
    text = F.concat(F.lit("w"), F.col("id") % 40)
    rows = spark.range(1_200_000).select(text.alias("line_text"), F.lit("py").alias("extension"))
    model = M.fit_prep(rows, word_vectors=True, vector_size=2, min_count=1)
    assert {r.word for r in model.stages[2].getVectors().collect()} == {f"w{i}" for i in range(40)}


def test_rare_words_get_no_weight(spark):
    rows = spark.createDataFrame([("a b",)] * 12 + [("c",)] * 9, "line_text string")
    words = M.tokenizer().transform(rows)
    hashed, weights = M.term_frequencies(n_hashes=1 << 16)
    model = weights.fit(hashed.transform(words))
    assert sorted(int(n) for n in model.docFreq if n >= M.MIN_DOC_FREQ) == [12, 12]
    assert sorted(round(v, 3) for v in model.idf.toArray() if v) == [0.526, 0.526]


def test_folds_hold_whole_pull_requests_and_weights_stand_for_copies(spark):
    rows = M.with_folds(weigh_classes(prepared(spark)))
    assert rows.select("pull_request_url", "fold").distinct().count() == 30
    assert {r.fold for r in rows.select("fold").collect()} == {0, 1, 2}
    copies = balance_classes(prepared(spark)).groupBy("label").count().collect()
    weights = rows.groupBy("label").agg(F.sum("weight").alias("count")).collect()
    assert sorted((r.label, float(r["count"])) for r in weights) == sorted((r.label, float(r["count"])) for r in copies)
    with pytest.raises(Exception, match="no positive examples"):
        weigh_classes(prepared(spark).where("label = 0")).collect()


def test_train_and_score(spark):
    trained = M.train_model(prepared(spark), **SMALL)
    assert len(M.cv_summary(trained.cross_validation)) == len(M.MIN_INFO_GAIN_GRID)
    scored = M.score(trained.model, prepared(spark))
    assert scored.where("p1 < 0 or p1 > 1 or p1 is null").count() == 0
    metrics = M.evaluate(scored)
    assert metrics["roc"] > 0.95 and metrics["pr"] > 0.9


def patch(n):
    lines = "\n".join(f"+{'danger' if i % 2 else 'fine'} {n * 10 + i}" for i in range(12))
    return f"From c{n} Mon\ndiff --git a/x/ab.py b/x/ab.py\n@@ -1,0 +1,12 @@\n{lines}"


def resolved_rows(spark, n=24):
    return spark.createDataFrame(
        [
            (
                f"https://api.h/repos/o/r/pulls/{k}", f"p{k}.patch",
                ("", "", [(2, 2), (8, 8)], [], [], ["x/ab.py"] * 2, [f"c{k}"] * 2), patch(k), "",
            )
            for k in range(n)
        ],
        schemas.RESOLVED,
    )


def test_training_job(spark, tmp_path):
    resolved, facts, out = (str(tmp_path / n) for n in ("resolved", "facts", "out"))
    resolved_rows(spark).write.parquet(resolved)
    spark.createDataFrame([("o/r", "ab.py", 3)], schemas.ISSUE_FACT).write.partitionBy("project").parquet(facts)
    jobs.train(spark, resolved, facts, out, str(tmp_path / "prep"), train=0.6, fast=True, **SMALL)
    report = spark.read.json(f"{out}/effectiveness").first()
    assert report.n > report.positives > 0 and 0 <= report.pr <= 1 and 0 <= report.roc <= 1
    assert len(report.cv) == 1
    with pytest.raises(Exception, match="already exists"):
        jobs.train(spark, resolved, facts, out, str(tmp_path / "prep"), train=0.6, fast=True, **SMALL)

    model = PipelineModel.load(f"{out}/model")
    requests = tables.read_resolved(spark, resolved).select("pull_request_url", "pull_patch_url")
    requests = requests.union(spark.createDataFrame([("https://api.h/repos/o/r/pulls/x", "gone.patch")], requests.schema))
    pages = tables.read_resolved(spark, resolved).select(
        F.col("pull_patch_url").alias("url"), F.lit(200).alias("status"), F.col("patch").alias("body")
    )
    suggestions, responses = jobs.score_requests(requests, pages, tables.read_issue_facts(spark, facts), model)
    per_request = suggestions.groupBy("pull_request_url").count().collect()
    assert per_request and all(r["count"] <= 7 for r in per_request)
    answers = {r.pull_request_url: r for r in responses.collect()}
    assert len(answers) == 25
    assert answers["https://api.h/repos/o/r/pulls/x"].message == "no text"


def event(n, action="opened"):
    return json.dumps(
        {
            "action": action,
            "number": n,
            "pull_request": {"url": f"u{n}", "patch_url": f"u{n}.patch", "title": f"t{n}", "number": n},
            "repository": {"name": "r", "full_name": "o/r", "owner": {"login": "o"}},
        }
    )


def texts(spark, lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


EVENTS = [event(1), event(2, "closed"), event(3), "not json", '{"number": 4}', event(5, "reopened")]


def test_opened_and_rejected(spark):
    decoded = S.decode_events(texts(spark, EVENTS))
    got = S.opened_pull_requests(decoded).orderBy("number").collect()
    assert [(r.pull_request_url, r.pull_patch_url, r.repo_name, r.owner, r.number, r.title) for r in got] == [
        ("u1", "u1.patch", "o/r", "o", 1, "t1"),
        ("u3", "u3.patch", "o/r", "o", 3, "t3"),
    ]
    assert sorted(r.value for r in S.rejected_events(decoded).collect()) == ["not json", '{"number": 4}']


def test_scoring_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def score(requests):
        return {"lines": requests.select("pull_request_url", F.lit(1).alias("line"))}

    def run():
        S.start_scoring(S.read_event_texts(spark, source, 1), score, out, state).awaitTermination()
        rejects = sorted(r.value for r in spark.read.parquet(f"{out}/rejects").collect())
        return sorted(r.pull_request_url for r in spark.read.parquet(f"{out}/lines").collect()), rejects

    texts(spark, EVENTS).write.text(source)
    bad = ["not json", '{"number": 4}']
    assert run() == (["u1", "u3"], bad)
    assert run() == (["u1", "u3"], bad)  # nothing new
    texts(spark, [event(7), event(8, "closed"), "[]"]).write.mode("append").text(source)
    assert run() == (["u1", "u3", "u7"], [*bad[:0], "[]", *bad])


def test_a_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    """The last entry of the log of finished batches is lost, as when a driver dies before it is written."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    runs = []

    def score(requests):
        runs.append(1)
        return {"lines": requests.select("pull_request_url")}

    def run():
        S.start_scoring(S.read_event_texts(spark, source), score, out, state).awaitTermination()
        return sorted(r.pull_request_url for r in spark.read.parquet(f"{out}/lines").collect())

    texts(spark, EVENTS).coalesce(1).write.text(source)
    assert run() == ["u1", "u3"]
    commits = tmp_path / "state" / "commits"
    for entry in commits.iterdir():
        if entry.name.strip(".").split(".")[0] == "0":
            entry.unlink()
    assert run() == ["u1", "u3"] and len(runs) == 2


def test_a_fitted_model_in_a_stream_says_what_it_says_in_a_batch(spark, tmp_path):
    rows = resolved_rows(spark)
    requests = rows.select("pull_request_url", "pull_patch_url")
    pages = rows.select(F.col("pull_patch_url").alias("url"), F.lit(200).alias("status"), F.col("patch").alias("body"))
    facts = str(tmp_path / "facts")
    spark.createDataFrame([("o/r", "ab.py", 3)], schemas.ISSUE_FACT).write.partitionBy("project").parquet(facts)
    facts = tables.read_issue_facts(spark, facts)
    model = M.train_model(prepared(spark), fast=True, **SMALL).model
    lines = requests.collect()
    events = [
        json.dumps({"action": "opened", "pull_request": {"url": r.pull_request_url, "patch_url": r.pull_patch_url}})
        for r in lines
    ]
    texts(spark, [*events, "x"]).repartition(3).write.text(str(tmp_path / "in"))
    source = S.read_event_texts(spark, str(tmp_path / "in"), max_files=1)
    out = str(tmp_path / "out")
    jobs.score_events(source, pages, facts, model, out, str(tmp_path / "state")).awaitTermination()
    suggestions, answers = jobs.score_requests(requests, pages, facts, model)
    for name, batch in (("suggestions", suggestions), ("answers", answers)):
        streamed = spark.read.parquet(f"{out}/{name}")
        assert sorted(map(str, streamed.select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    assert suggestions.count() > 0 and spark.read.parquet(f"{out}/answers").count() == len(lines)
    assert [r.value for r in spark.read.parquet(f"{out}/rejects").collect()] == ["x"]


def test_scoring_reads_each_body_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(text):
        read.add(1)
        return text

    good = "diff --git a/x/ab.py b/x/ab.py\n@@ -1,2 +1,2 @@\n-a\n+b"
    bad = "diff --git a/x/ab.py b/x/ab.py\n@@ -99999999999,2 +1,2 @@\n+b"
    rows = [("u0.patch", f"From c1 x\n{good}"), ("u1.patch", bad), ("u2.patch", None), ("u3.patch", good)]
    pages = spark.createDataFrame(rows, "url string, text string").repartition(2).select("url", body("text").alias("body"))
    requests = spark.createDataFrame(
        [(f"u{i}", f"u{i}.patch") for i in range(5)], "pull_request_url string, pull_patch_url string"
    )
    facts = spark.createDataFrame([], schemas.ISSUE_FACT)
    _, answers = jobs.score_requests(
        requests, pages, facts, lambda lines: lines.withColumns({"prediction": F.lit(1.0), "p1": F.lit(0.5)})
    )
    got = {r.pull_request_url: (len(r.positions), r.message) for r in answers.collect()}
    unfit, no_commit = "line number does not fit an int", "line without a commit"
    assert got == {"u0": (2, None), "u1": (0, unfit), "u2": (0, "no text"), "u3": (0, no_commit), "u4": (0, "no text")}
    assert read.value == len(rows)


def test_event_log_stream(spark, tmp_path):
    source, out, rejects, state = (str(tmp_path / n) for n in ("in", "out", "rejects", "state"))
    texts(spark, EVENTS).write.text(source)
    for q in S.start_event_log(S.read_event_texts(spark, source), out, rejects, state):
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert spark.read.parquet(rejects).count() == 2


def test_dedupe_forgets_and_counts_late_rows(spark, tmp_path):
    schema = "pull_request_url string, commit_id string, filename string, line int, t string"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(*rows):
        df = spark.createDataFrame([("u", "c", "f", n, f"2024-01-01 {t}") for n, t in rows], schema)
        df = df.withColumn("t", F.col("t").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        q = S.start_dedupe(spark.readStream.schema(df.schema).parquet(source), "t", out, state)
        q.awaitTermination()
        got = spark.read.parquet(out).select("line", F.date_format("t", "HH:mm").alias("t")).collect()
        return sorted(tuple(r) for r in got), S.late_rows(q)

    first = [(1, "12:00"), (2, "12:00")]
    assert run((1, "12:00"), (1, "12:00"), (2, "12:00")) == (first, 0)
    assert run((1, "12:30"), (2, "12:10")) == (first, 0)
    assert run((3, "15:00")) == ([*first, (3, "15:00")], 0)
    # What was seen at noon is forgotten; what comes from then is late.
    assert run((1, "15:10"), (4, "12:05")) == ([(1, "12:00"), (1, "15:10"), (2, "12:00"), (3, "15:00")], 1)
    assert run((1, "15:20")) == ([(1, "12:00"), (1, "15:10"), (2, "12:00"), (3, "15:00")], 0)
