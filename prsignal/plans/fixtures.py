"""Pull-request-shaped views over the given tables.

The given tables hold no pull requests, so these views derive them: an event
archive from ``events``; patches, review comments, issue texts and responses
from ``documents`` and ``labels``; pull-request events from ``orders``.  Every
view is a plain projection of whole tables with all their text, so it grows
with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prsignal.functions.arrays import bind, compute_once
from prsignal.functions.text import bucket_of
from prsignal.operators.comments import comments_of_rows
from prsignal.operators.patch import parse_patches

HOST = "https://api.example.com/repos/"
WEB = "https://example.com/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt by id: the given table is one file that one task would read."""
    return table(spark, sf_dir, "documents").repartition("doc_id")


# SQL of names that hang on a key.


def project(key: str) -> str:
    return f"concat('org', {key} % 10, '/repo', {key} % 25)"


def pull_request_url(key: str) -> str:
    return f"concat('{HOST}', {project(key)}, '/pulls/', {key})"


def patch_url(key: str) -> str:
    return f"concat('{WEB}', {project(key)}, '/pull/', {key}, '.patch')"


# -- event archive ---------------------------------------------------------


def archive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = f"""CASE WHEN event_id % 53 = 0 THEN 'null' WHEN event_id % 59 = 0 THEN '"null"'
        ELSE concat('"', {pull_request_url("user_id")}, '"') END"""
    position = """CASE WHEN event_id % 5 = 0 THEN 'null'
        ELSE coalesce(get_json_object(props, '$.k'), 'null') END"""
    path = """CASE WHEN event_id % 7 = 0 THEN 'null'
        ELSE concat('"src/mod', event_id % 50, '.py"') END"""
    payload = f"""concat(
        '{{"action":"', get(array('opened', 'closed', 'reopened'), CAST(event_id % 3 AS INT)),
        '","pull_request":{{"url":', {url}, ',"patch_url":"', {patch_url("user_id")},
        '"}},"comment":{{"original_position":', event_id % 20, ',"position":', {position},
        ',"commit_id":"', md5(CAST(event_id AS STRING)), '","path":', {path},
        ',"body":"note ', event_id, r'","diff_hunk":"@@ -1,2 +1,3 @@\\n a\\n+b', event_id,
        '"}},"issue":{{"url":"{HOST}', {project("user_id")}, '/issues/', event_id, '"}}}}')"""
    return table(spark, sf_dir, "events").repartition("event_id").selectExpr(
        "event_id",
        "ts",
        """CASE event_type WHEN 'click' THEN 'PullRequestReviewCommentEvent'
            WHEN 'view' THEN 'PullRequestEvent2' WHEN 'signup' THEN 'IssuesEvent'
            ELSE event_type END AS type""",
        f"named_struct('name', {project('user_id')}) AS repo",
        f"CASE WHEN event_id % 97 = 0 THEN '{{broken' ELSE {payload} END AS payload",
        "date_format(ts, 'yyyyMMdd') AS day",
    )


# -- patches ---------------------------------------------------------------

COMMIT_ONE = "md5(CAST(doc_id AS STRING))"
COMMIT_TWO = "md5(concat(doc_id, 'b'))"
FILE_ONE = (
    "concat('src/pkg', doc_id % 7, '/mod', doc_id % 50, '.', "
    "get(array('py', 'go', 'md', 'java'), CAST(doc_id % 4 AS INT)))"
)
FILE_TWO = "concat('lib/util', doc_id % 50, '.py')"


def _body_line(line: str = "line", i: str = "i") -> str:
    """A text line as a body line of a patch."""
    return f"concat(get(array(' ', '+', '-'), CAST((doc_id + {i}) % 3 AS INT)), {line})"


def _mail(commit: str) -> str:
    return (
        f"concat('From ', {commit}, ' Mon Sep 17 00:00:00 2001\\nFrom: dev <dev@example.com>\\n"
        "Subject: [PATCH] change ', doc_id, '\\n---\\n one file\\n\\n')"
    )


def _file(name: str) -> str:
    return (
        f"concat('diff --git a/', {name}, ' b/', {name}, '\\nindex 1111111..2222222 100644\\n"
        f"--- a/', {name}, '\\n+++ b/', {name}, '\\n')"
    )


# Every text line becomes a body line; header lines stand in front of some.
PATCH = f"""concat(array_join(transform(split(text, '\\n', -1), (line, i) -> concat(
    CASE i
        WHEN 0 THEN concat({_mail(COMMIT_ONE)}, {_file(FILE_ONE)}, '@@ -', 10 + doc_id % 5,
            ',9 +', 12 + doc_id % 5, ',9 @@ def f():\\n')
        WHEN 4 THEN concat('@@ -', CASE WHEN doc_id % 41 = 5 THEN '99999999999' ELSE '40' END,
            ',5 +44,6 @@\\n')
        WHEN 8 THEN concat({_file(FILE_TWO)}, '@@ -70,3 +75,4 @@ class C\\n')
        WHEN 12 THEN concat({_mail(COMMIT_TWO)}, {_file(FILE_ONE)}, '@@ -20,8 +21,8 @@\\n')
        ELSE '' END,
    {_body_line()})), '\\n'), '\\n-- \\n2.30\\n')"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patch_id, patch): every document as a patch of up to two commits and two files.

    Each patch is put together once, as if it had been read from a table.
    """
    docs = documents(spark, sf_dir)
    return compute_once(docs, patch=PATCH).selectExpr("doc_id AS patch_id", "patch")


def long_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patch_id, patch): every document as a patch that changes one line as long as the document."""
    line = "replace(text, '\\n', ' ')"
    patch = f"concat('diff --git a/', {FILE_ONE}, ' b/', {FILE_ONE}, '\\n@@ -1,2 +1,2 @@\\n-', {line}, '\\n+', {line}, ' ')"
    return compute_once(documents(spark, sf_dir), patch=patch).selectExpr("doc_id AS patch_id", "patch")


# -- review comments -------------------------------------------------------

# Aligned arrays over the numbers js of a document's comments.
NEW = "transform(js, j -> CAST(1 + (doc_id * 7 + j * 5) % 13 AS INT))"
OLD = """transform(js, j ->
    CASE WHEN j != 2 THEN CAST(1 + (doc_id * 7 + j * 5) % 13 + j % 2 AS INT) END)"""
TEXTS = "transform(js, j -> CASE WHEN j = 3 THEN '' ELSE concat('note ', j) END)"
# All lines of the text in as many parts as there are comments, a hunk for each.
# The text is split once for all of them, and not once more for every line.
HUNKS = bind(
    "split(text, '\\n', -1)",
    "text_lines",
    f"""transform(js, j -> concat('@@ -5,4 +5,6 @@ x\\n', array_join(
    transform(
        filter(
            transform(text_lines, (line, i) -> named_struct('line', line, 'i', i)),
            s -> s.i * n_comments div size(text_lines) = j),
        s -> {_body_line("s.line", "s.i")}), '\\n')))""",
)
PATHS = f"transform(js, j -> CASE WHEN j % 2 = 0 THEN {FILE_ONE} ELSE {FILE_TWO} END)"
COMMITS = f"transform(js, j -> CASE WHEN j = 1 THEN {COMMIT_TWO} ELSE {COMMIT_ONE} END)"


def _documents_with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        documents(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .selectExpr(
            "doc_id",
            "text",
            """CASE quality WHEN 1 THEN 1 + doc_id % 4 WHEN 0 THEN doc_id % 2 ELSE 0 END
                AS n_comments""",
        )
        .selectExpr("*", "filter(array(0, 1, 2, 3), j -> j < n_comments) AS js")
    )


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as the archive gives them: texts in quotes, hunks as JSON, positions as text."""
    literal = "substring(to_json(array(x)), 2, length(to_json(array(x))) - 2)"
    return _documents_with_comments(spark, sf_dir).selectExpr(
        f"concat('\"', {patch_url('doc_id')}, '\"') AS pull_patch_url",
        "'\"2024-01-01T00:00:00Z\"' AS created_date",
        f"""CASE WHEN doc_id % 29 = 3 THEN NULL WHEN doc_id % 31 = 4 THEN 'null'
            ELSE concat('"', {pull_request_url("doc_id")}, '"') END AS pull_request_url""",
        f"""zip_with({OLD}, {NEW}, (old, new) -> map(
            'original_position', coalesce(CAST(old AS STRING), ' x'),
            'new_position', CAST(new AS STRING))) AS comment_positions""",
        f"{TEXTS} AS comment_text",
        f"transform({HUNKS}, x -> {literal}) AS diff_hunks",
        f"transform({COMMITS}, x -> concat('\"', x, '\"')) AS comment_commit_ids",
        f"transform({PATHS}, x -> concat('\"', x, '\"')) AS comment_file_paths",
    )


URL, PAGE = pull_request_url("doc_id"), patch_url("doc_id")
PARSED = f"""named_struct('pull_request_url', {URL}, 'pull_patch_url', {PAGE},
    'comment_positions', zip_with({OLD}, {NEW}, (old, new) ->
        named_struct('original_position', old, 'new_position', new)),
    'comment_text', {TEXTS}, 'diff_hunks', {HUNKS}, 'comment_file_paths', {PATHS},
    'comment_commit_ids', {COMMITS})"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a pull request with clean comments and its patch."""
    docs = _documents_with_comments(spark, sf_dir)
    return compute_once(docs, parsed_input=PARSED, patch=PATCH).selectExpr(
        f"{URL} AS pull_request_url",
        f"{PAGE} AS pull_patch_url",
        "parsed_input",
        "patch",
        "concat('diff of ', doc_id) AS diff",
    )


def resolved_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two rows: one comment in two is of the first day, when the patch was another one."""
    days = (
        _documents_with_comments(spark, sf_dir)
        .withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("js", F.expr("filter(js, j -> j % 2 = n)"))
    )
    outdated = f"concat({_file(FILE_ONE)}, '@@ -1,2 +1,2 @@\\n+outdated ', doc_id)"
    patch = f"CASE n WHEN 0 THEN {outdated} ELSE {PATCH} END"
    return compute_once(days, parsed_input=PARSED, patch=patch).selectExpr(
        f"{URL} AS pull_request_url", "parsed_input", "patch", "CAST(20240101 + n AS STRING) AS day"
    )


def hot_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments as rows, where a third of them belong to one pull request and its two files."""
    number = "CAST(regexp_extract(pull_request_url, '[0-9]+$', 0) AS BIGINT)"

    def of_hot(sql: str) -> str:
        return sql.replace("doc_id", "CAST(0 AS BIGINT)")

    rows = comments_of_rows(resolved(spark, sf_dir)).selectExpr("*", f"{number} AS doc_id")
    return rows.selectExpr(
        f"CASE WHEN doc_id % 3 = 0 THEN {of_hot(URL)} ELSE pull_request_url END AS pull_request_url",
        f"""CASE WHEN doc_id % 3 != 0 THEN filename WHEN item % 2 = 0 THEN {of_hot(FILE_ONE)}
            ELSE {of_hot(FILE_TWO)} END AS filename""",
        f"""CASE WHEN doc_id % 3 != 0 THEN commit_id WHEN item = 1 THEN {of_hot(COMMIT_TWO)}
            ELSE {of_hot(COMMIT_ONE)} END AS commit_id""",
        "original_position", "new_position", "comment_text", "hunk", "day",
        "doc_id * 4 + item AS item", "has_hunk", "has_position", "has_commit",
    )


# -- responses, cache, issues ----------------------------------------------


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response table: patch and diff page of every pull request, some not found."""
    page = patch_url("doc_id")
    # One column after the other, so that a reader of urls alone moves no text.
    return documents(spark, sf_dir).selectExpr("doc_id", "text", "explode(array(false, true)) AS is_diff").selectExpr(
        f"CASE WHEN is_diff THEN regexp_replace({page}, r'\\.patch$', '.diff') ELSE {page} END AS url",
        """CASE WHEN is_diff THEN CASE WHEN doc_id % 13 = 0 THEN 500 ELSE 200 END
            WHEN doc_id % 11 = 0 THEN 404 ELSE 200 END AS status""",
        f"CASE WHEN is_diff THEN concat('diff of ', doc_id) ELSE {PATCH} END AS body",
    )


def cached_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        documents(spark, sf_dir)
        .where("doc_id % 17 = 0")
        .selectExpr(
            f"{pull_request_url('doc_id')} AS pull_request_url", "text AS patch", "'' AS diff"
        )
    )


def issue_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, url) with the url in quotes, as the CSV extract gives it."""
    return table(spark, sf_dir, "documents").selectExpr(
        f"{project('doc_id')} AS name",
        f"""concat('"', CASE WHEN doc_id % 2 = 0 THEN '"' ELSE '' END,
            '{WEB}issues/', doc_id, '"') AS url""",
    )


ISSUE_BODY = """array_join(transform(split(text, '\\n', -1), (line, i) -> concat(
    line, '\\n  at f(mod', doc_id % 50, '.py:', 10 + (doc_id + i * 3) % 12,
    ')\\n  /usr/lib/util', (doc_id + i) % 50, '.py:', 70 + i, ' in g\\n')), '\\n')"""


def issue_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(
        f"concat('{WEB}issues/', doc_id) AS url",
        "CASE WHEN doc_id % 19 = 0 THEN 404 ELSE 200 END AS status",
        f"{ISSUE_BODY} AS body",
    )


def issue_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, body): every document as an issue with stack frames between its lines."""
    return documents(spark, sf_dir).selectExpr(
        f"{project('doc_id')} AS name", f"{ISSUE_BODY} AS body"
    )


# -- scoring ---------------------------------------------------------------


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of all patches, with the url and project of their pull request."""
    return parse_patches(patches(spark, sf_dir)).selectExpr(
        f"{pull_request_url('patch_id')} AS pull_request_url",
        f"{project('patch_id')} AS project",
        "*",
    )


def unit_score(key: Column) -> Column:
    """A number in [0, 1) with three decimals, from the hash of a key."""
    return bucket_of(key, 1000) / F.lit(1000.0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every changed line, each listed twice with two scores."""
    key = F.concat_ws(":", "patch_id", "line_at", "copy")
    lines = changed(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return lines.select(
        "pull_request_url",
        "filename",
        F.col("position").alias("offset"),
        F.when(F.col("line_at") % 23 != 0, F.col("commit_id")).alias("commit_id"),
        unit_score(key).alias("p1"),
        (bucket_of(F.concat(key, F.lit("y")), 10) < 3).cast("double").alias("label"),
    ).withColumn("prediction", (F.col("p1") >= 0.5).cast("double"))


# -- pull-request events ---------------------------------------------------


def pull_request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts of pull-request events with their time, one per order."""
    key = "o_orderkey"
    value = f"""concat(
        '{{"action":', CASE WHEN {key} % 37 = 0 THEN 'null' WHEN o_orderstatus = 'O' THEN '"opened"'
            WHEN o_orderstatus = 'F' THEN '"closed"' ELSE '"reopened"' END,
        ',"number":', {key}, ',"pull_request":{{"url":"', {pull_request_url(key)},
        '","patch_url":"', {patch_url(key)}, '","title":"change ', {key}, '","number":', {key},
        '}},"repository":{{"name":"repo', {key} % 25, '","full_name":"', {project(key)},
        '","owner":{{"login":"org', {key} % 10, '"}}}}}}')"""
    return table(spark, sf_dir, "orders").repartition(key).selectExpr(
        f"CASE WHEN {key} % 43 = 0 THEN 'not json' ELSE {value} END AS value",
        f"{key} AS order_key",
        "o_orderdate AS sent_at",
    )
