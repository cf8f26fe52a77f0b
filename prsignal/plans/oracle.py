"""The registered queries as plain SQL over the given tables, to check results against.

The SQL works with windows over one row per line and with joins, not with the
array expressions of the library, so that the two can disagree.
"""

from __future__ import annotations

import re

from prsignal.functions.messages import GREETINGS, PHRASES
from prsignal.functions.text import FILE_FORMATS

# Views shared by the queries; each may use the ones before it.
VIEWS: dict[str, str] = {}

VIEWS["docs"] = """
SELECT doc_id AS d, text, string_split(text, chr(10)) AS lines,
  'org' || (doc_id % 10) || '/repo' || (doc_id % 25) AS project,
  'https://api.example.com/repos/org' || (doc_id % 10) || '/repo' || (doc_id % 25) || '/pulls/'
    || doc_id AS pr,
  'https://example.com/org' || (doc_id % 10) || '/repo' || (doc_id % 25) || '/pull/' || doc_id
    AS page,
  md5(doc_id::VARCHAR) AS c1, md5(doc_id || 'b') AS c2,
  'src/pkg' || (doc_id % 7) || '/mod' || (doc_id % 50) || '.'
    || CASE doc_id % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'md' ELSE 'java' END AS f1,
  'lib/util' || (doc_id % 50) || '.py' AS f2
FROM documents"""

VIEWS["patch_parts"] = """
SELECT d, i,
  CASE i
    WHEN 0 THEN 'From ' || c1 || mail || head1 || '@@ -' || (10 + d % 5) || ',9 +' || (12 + d % 5)
      || ',9 @@ def f():' || chr(10)
    WHEN 4 THEN '@@ -' || CASE WHEN d % 41 = 5 THEN '99999999999' ELSE '40' END || ',5 +44,6 @@'
      || chr(10)
    WHEN 8 THEN head2 || '@@ -70,3 +75,4 @@ class C' || chr(10)
    WHEN 12 THEN 'From ' || c2 || mail || head1 || '@@ -20,8 +21,8 @@' || chr(10)
    ELSE '' END
  || CASE (d + i) % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END || line AS part
FROM (
  SELECT d, c1, c2, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i,
    ' Mon Sep 17 00:00:00 2001' || chr(10) || 'From: dev <dev@example.com>' || chr(10)
      || 'Subject: [PATCH] change ' || d || chr(10) || '---' || chr(10) || ' one file' || chr(10)
      || chr(10) AS mail,
    'diff --git a/' || f1 || ' b/' || f1 || chr(10) || 'index 1111111..2222222 100644' || chr(10)
      || '--- a/' || f1 || chr(10) || '+++ b/' || f1 || chr(10) AS head1,
    'diff --git a/' || f2 || ' b/' || f2 || chr(10) || 'index 1111111..2222222 100644' || chr(10)
      || '--- a/' || f2 || chr(10) || '+++ b/' || f2 || chr(10) AS head2
  FROM docs)"""

VIEWS["patches"] = """
SELECT d, string_agg(part, chr(10) ORDER BY i) || chr(10) || '-- ' || chr(10) || '2.30' || chr(10)
  AS patch
FROM patch_parts GROUP BY d"""

# Texts to parse: (k, hunk_mode, text).  k is unique.
_PARSE = """
SELECT k, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln
FROM {texts}"""

_KINDS = """
SELECT *,
  regexp_matches(line, '^diff --git a/.* b/.*$') AS is_diff,
  regexp_matches(line, '^From\\s[A-Za-z0-9]+\\s.*$') AS is_commit,
  regexp_matches(line, '^@@ -[0-9]+,[0-9]+ \\+[0-9]+,[0-9]+ @@.*$') AS is_header,
  regexp_matches(line, '^[-+\\s].*$') AS is_body,
  regexp_matches(line, '^---\\sa/.+$') AS is_old_file
FROM {raw}"""

_SECTIONS = """
SELECT *,
  sum((is_diff OR is_commit)::INT) OVER w AS section,
  last_value(CASE WHEN is_commit THEN regexp_extract(line, '^From\\s([A-Za-z0-9]+)', 1) END
    IGNORE NULLS) OVER w AS commit_id,
  last_value(CASE WHEN is_diff THEN 'd' WHEN is_commit THEN 'c' END IGNORE NULLS) OVER w AS opened_by,
  list(CASE WHEN is_body AND NOT is_old_file THEN substr(line, 2) END)
    FILTER (WHERE is_body AND NOT is_old_file)
    OVER (PARTITION BY k ORDER BY ln ROWS BETWEEN CURRENT ROW AND {ahead} FOLLOWING) AS nexts
FROM {kinds} WINDOW w AS (PARTITION BY k ORDER BY ln)"""

_HUNKS = """
SELECT *, (is_header AND {active}) AS header,
  sum((is_header AND {active})::INT) OVER (PARTITION BY k, section ORDER BY ln) AS hunk
FROM {sections}"""

_FILES = """
SELECT *,
  last_value(CASE WHEN is_diff THEN regexp_extract(line, '^diff --git a/.* b/(.*)$', 1)
    WHEN hunk = 0 AND opened_by = 'd' AND regexp_matches(line, '^\\+\\+\\+\\sb/.+$')
    THEN regexp_extract(line, '^\\+\\+\\+\\sb/(.+)$', 1) END IGNORE NULLS)
    OVER (PARTITION BY k, section ORDER BY ln) AS filename,
  (is_body AND hunk > 0 AND NOT header) AS body,
  last_value(CASE WHEN header
    THEN regexp_extract(line, '^@@ -([0-9]+)', 1)::BIGINT END IGNORE NULLS)
    OVER (PARTITION BY k, section ORDER BY ln) AS old0,
  last_value(CASE WHEN header
    THEN regexp_extract(line, '^@@ -[0-9]+,[0-9]+ \\+([0-9]+)', 1)::BIGINT END IGNORE NULLS)
    OVER (PARTITION BY k, section ORDER BY ln) AS new0
FROM {hunks}"""

_COUNTED = """
SELECT *,
  CASE WHEN opened_by = 'd' THEN -1 ELSE 0 END
    + sum((header OR body)::INT) OVER (PARTITION BY k, section ORDER BY ln) AS position,
  old0 - 1 + sum((body AND line[1] <> '+')::INT) OVER (PARTITION BY k, section, hunk ORDER BY ln)
    AS old_pos,
  new0 - 1 + sum((body AND line[1] <> '-')::INT) OVER (PARTITION BY k, section, hunk ORDER BY ln)
    AS new_pos,
  list(substr(line, 2)) FILTER (WHERE body) OVER (PARTITION BY k, section, hunk, body ORDER BY ln
    ROWS BETWEEN {behind} PRECEDING AND CURRENT ROW) AS prevs
FROM {files}"""

_RECORDS = """
SELECT k, ln::INT AS line_at, commit_id, old_pos::INT AS old_pos, new_pos::INT AS new_pos,
  position::INT AS position, array_to_string(prevs, '¶') AS previous_lines,
  substr(line, 2) AS text, array_to_string(nexts, '¶') AS next_lines, filename,
  line[1] = '+' AS is_added
FROM {counted}
WHERE body AND line[1] IN ('+', '-')
  AND k NOT IN (SELECT k FROM {files} WHERE header AND greatest(old0, new0) > 2147483647)"""


def _parser(name: str, texts: str, active: str, behind: int = 3, ahead: int = 3) -> None:
    """Views that parse the texts of a view into ``name``, one row per changed line."""
    steps = [
        ("raw", _PARSE),
        ("kinds", _KINDS),
        ("sections", _SECTIONS),
        ("hunks", _HUNKS),
        ("files", _FILES),
        ("counted", _COUNTED),
    ]
    names = {step: f"{name}_{step}" for step, _ in steps}
    for step, sql in [*steps, ("", _RECORDS)]:
        VIEWS[names.get(step, name)] = sql.format(
            texts=texts, active=active, behind=behind, ahead=ahead, **names
        )


VIEWS["patch_texts"] = "SELECT d AS k, patch AS text FROM patches"
_parser("records", "patch_texts", "opened_by = 'd'")
VIEWS["long_texts"] = """
SELECT d AS k, 'diff --git a/' || f1 || ' b/' || f1 || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || '-'
  || replace(text, chr(10), ' ') || chr(10) || '+' || replace(text, chr(10), ' ') || ' ' AS text
FROM docs"""
_parser("long_records", "long_texts", "opened_by = 'd'")
_parser("short_records", "patch_texts", "opened_by = 'd'", behind=1, ahead=1)

VIEWS["comments"] = """
SELECT d, pr, page, j, c1, c2, f1, f2, lines, count(*) OVER (PARTITION BY d) AS n_comments,
  (1 + (d * 7 + j * 5) % 13)::INT AS new_at,
  CASE WHEN j <> 2 THEN (1 + (d * 7 + j * 5) % 13 + j % 2)::INT END AS old_at,
  CASE WHEN j = 3 THEN '' ELSE 'note ' || j END AS comment_text,
  CASE WHEN j % 2 = 0 THEN f1 ELSE f2 END AS filename,
  CASE WHEN j = 1 THEN c2 ELSE c1 END AS commit_id
FROM docs JOIN labels ON labels.doc_id = docs.d, unnest([0, 1, 2, 3]) AS t(j)
WHERE j < CASE quality WHEN 1 THEN 1 + d % 4 WHEN 0 THEN d % 2 ELSE 0 END"""

VIEWS["comment_hunks"] = """
SELECT d, pr, j, comment_text, filename, commit_id, old_at, new_at,
  '@@ -5,4 +5,6 @@ x' || chr(10) || coalesce((
    SELECT string_agg(CASE (d + i) % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END || line,
      chr(10) ORDER BY i)
    FROM (SELECT unnest(c.lines) AS line, generate_subscripts(c.lines, 1) - 1 AS i)
    WHERE i * c.n_comments // len(c.lines) = j), '') AS hunk
FROM comments c"""

VIEWS["hunk_texts"] = "SELECT d || ':' || j AS k, hunk AS text FROM comment_hunks"
_parser("hunk_lines", "hunk_texts", "opened_by IS DISTINCT FROM 'c'")

VIEWS["hunk_records"] = """
SELECT c.d, c.pr, 0 AS source, c.j::INT AS item, r.line_at, r.previous_lines, r.text AS line_text,
  r.next_lines, c.filename, r.is_added, TRUE AS commented, r.old_pos AS line, c.comment_text
FROM hunk_lines r JOIN comment_hunks c ON r.k = c.d || ':' || c.j"""

VIEWS["flags"] = """
SELECT r.*,
  EXISTS (SELECT 1 FROM comments c WHERE c.d = r.k AND c.filename = r.filename
    AND c.commit_id = r.commit_id AND r.position IN (c.new_at, c.old_at)) AS hit,
  EXISTS (SELECT 1 FROM comments c WHERE c.d = r.k AND c.filename = r.filename
    AND (abs(r.position - c.new_at) <= 1 OR abs(r.position - c.old_at) <= 1)) AS near
FROM records r"""

VIEWS["flags_compat"] = """
SELECT r.*,
  EXISTS (SELECT 1 FROM comments c WHERE c.d = r.k AND c.filename = r.filename
    AND c.commit_id = r.commit_id AND (r.new_pos = c.new_at OR r.old_pos = c.old_at)) AS hit,
  EXISTS (SELECT 1 FROM comments c WHERE c.d = r.k AND c.filename = r.filename
    AND (abs(r.new_pos - c.new_at) <= 1 OR abs(r.new_pos - c.old_at) <= 1
      OR abs(r.old_pos - c.new_at) <= 1 OR abs(r.old_pos - c.old_at) <= 1)) AS near
FROM records r"""

_PATCH_RECORDS = """
SELECT f.k AS d, docs.pr, 1 AS source, 0 AS item, f.line_at, f.previous_lines, f.text AS line_text,
  f.next_lines, f.filename, f.is_added, {commented} AS commented, f.old_pos AS line,
  '' AS comment_text
FROM {flags} f JOIN docs ON docs.d = f.k WHERE {kept}"""
VIEWS["patch_records"] = _PATCH_RECORDS.format(flags="flags", commented="hit", kept="hit OR NOT near")
VIEWS["patch_records_compat"] = _PATCH_RECORDS.format(
    flags="flags_compat", commented="TRUE", kept="near AND NOT hit"
)

_ALL = "SELECT * FROM hunk_records UNION ALL SELECT * FROM {patch_records}"
VIEWS["all_records"] = _ALL.format(patch_records="patch_records")
VIEWS["all_records_compat"] = _ALL.format(patch_records="patch_records_compat")

_CHOSEN = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY pr, line_text ORDER BY
    CASE WHEN commented AND comment_text <> '' THEN 0 WHEN commented THEN 1 ELSE 2 END,
    source, item, line_at) AS nth
  FROM {records}) WHERE nth = 1"""
VIEWS["chosen"] = _CHOSEN.format(records="all_records")
VIEWS["labelled"] = (
    "SELECT * FROM chosen WHERE pr IN (SELECT pr FROM all_records WHERE commented)"
)
VIEWS["labelled_by_day"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY pr, line_text ORDER BY
    CASE WHEN commented AND comment_text <> '' THEN 0 WHEN commented THEN 1 ELSE 2 END,
    source, item % 2, item, line_at) AS nth
  FROM all_records WHERE pr IN (SELECT pr FROM all_records WHERE commented)) WHERE nth = 1"""
VIEWS["hot_comments"] = """
SELECT c.d || ':' || c.j AS k, CASE WHEN c.d % 3 = 0 THEN 0 ELSE c.d END AS d, c.d * 4 + c.j AS item,
  c.new_at, c.old_at, c.comment_text,
  CASE WHEN c.d % 3 <> 0 THEN c.filename WHEN c.j % 2 = 0 THEN z.f1 ELSE z.f2 END AS filename,
  CASE WHEN c.d % 3 <> 0 THEN c.commit_id WHEN c.j = 1 THEN z.c2 ELSE z.c1 END AS commit_id
FROM comment_hunks c, docs z WHERE z.d = 0"""
VIEWS["hot_flags"] = """
SELECT r.*, coalesce(h.hit, FALSE) AS hit, coalesce(h.near, FALSE) AS near
FROM records r LEFT JOIN (
  SELECT r.k, r.line_at, bool_or(c.commit_id = r.commit_id AND r.position IN (c.new_at, c.old_at)) AS hit,
    bool_or(coalesce(abs(r.position - c.new_at) <= 1, FALSE)
      OR coalesce(abs(r.position - c.old_at) <= 1, FALSE)) AS near
  FROM records r JOIN hot_comments c ON c.d = r.k AND c.filename = r.filename GROUP BY r.k, r.line_at) h
  ON h.k = r.k AND h.line_at = r.line_at"""
VIEWS["hot_records"] = """
SELECT docs.pr, 0 AS source, c.item, r.line_at, r.previous_lines, r.text AS line_text, r.next_lines,
  c.filename, r.is_added, TRUE AS commented, r.old_pos AS line, c.comment_text
FROM hunk_lines r JOIN hot_comments c ON r.k = c.k JOIN docs ON docs.d = c.d
UNION ALL
SELECT docs.pr, 1, 0, f.line_at, f.previous_lines, f.text, f.next_lines, f.filename, f.is_added, f.hit,
  f.old_pos, ''
FROM hot_flags f JOIN docs ON docs.d = f.k WHERE hit OR NOT near"""
VIEWS["hot_chosen"] = _CHOSEN.format(records="hot_records")
VIEWS["labelled_compat"] = _CHOSEN.format(records="all_records_compat")

VIEWS["issue_bodies"] = """
SELECT d, project, string_agg(
  line || chr(10) || '  at f(mod' || (d % 50) || '.py:' || (10 + (d + i * 3) % 12) || ')' || chr(10)
    || '  /usr/lib/util' || ((d + i) % 50) || '.py:' || (70 + i) || ' in g' || chr(10),
  chr(10) ORDER BY i) AS body
FROM (SELECT d, project, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM docs)
GROUP BY d, project"""

_FRAME = r"[\s\\/]+([^ /]*?\.(scala|java|go|cpp|py|pyc)):([0-9]+)\s*"
VIEWS["frames"] = f"""
SELECT project, unnest(names) AS filename, unnest(numbers)::INT AS line
FROM (SELECT project, regexp_extract_all(body, '{_FRAME}', 1) AS names,
    regexp_extract_all(body, '{_FRAME}', 3) AS numbers
  FROM (SELECT project, replace(replace(body, '(', ' '), ')', ' ') AS body FROM issue_bodies))"""
VIEWS["facts"] = "SELECT DISTINCT project, filename, line FROM frames"


def _quoted(texts: tuple[str, ...]) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


_FORMATS = f"({_quoted(tuple(f.lower() for f in FILE_FORMATS))})"


def _ext(name: str) -> str:
    found = f"regexp_extract(lower({name}), '^.+[a-z0-9]+\\.([a-z+]*?)$', 1)"
    return f"CASE WHEN {found} IN {_FORMATS} THEN {found} END"


def _base(name: str) -> str:
    return f"regexp_replace({name}, '^.*/', '')"


def _bucket(key: str, n: int) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT % {n})"


VIEWS["prepared"] = f"""
SELECT l.pr, l.line_text, l.filename, l.is_added, l.commented::INT::DOUBLE AS commented,
  {_ext("l.filename")} AS extension, length(l.line_text)::DOUBLE AS line_length,
  l.commented::INT::DOUBLE AS label,
  regexp_matches(l.line_text, '^\\s+$')::INT::DOUBLE AS only_spaces,
  (NOT EXISTS (SELECT 1 FROM facts f WHERE f.project = docs.project AND f.line = l.line
    AND f.filename = {_base("l.filename")}))::INT::DOUBLE AS not_in_issues,
  NULL::VARCHAR AS commit_id, NULL::INT AS "offset", l.previous_lines, l.next_lines
FROM labelled l JOIN docs ON docs.pr = l.pr"""

_KEY = "r.k || ':' || r.line_at || ':' || copy"
VIEWS["predictions"] = f"""
SELECT docs.pr, r.filename, r.position AS line,
  CASE WHEN r.line_at % 23 <> 0 THEN r.commit_id END AS commit_id,
  {_bucket(_KEY, 1000)} / 1000.0::DOUBLE AS p1,
  ({_bucket(_KEY + " || 'y'", 10)} < 3)::INT AS label
FROM records r JOIN docs ON docs.d = r.k, unnest([0, 1]) AS t(copy)"""
VIEWS["positive"] = """
SELECT DISTINCT pr, filename, line, commit_id, p1 FROM predictions WHERE p1 >= 0.5"""
VIEWS["best"] = """
SELECT pr, filename, line, commit_id, max(p1) AS p1 FROM positive
GROUP BY pr, filename, line, commit_id"""
VIEWS["top"] = """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY pr ORDER BY p1 DESC, filename, line, commit_id)::INT
    AS rank
  FROM best WHERE commit_id IS NOT NULL) WHERE rank <= 7"""

VIEWS["archive"] = """
SELECT *, strftime(ts, '%Y%m%d') AS day,
  CASE event_type WHEN 'click' THEN 'PullRequestReviewCommentEvent'
    WHEN 'view' THEN 'PullRequestEvent2' WHEN 'signup' THEN 'IssuesEvent' ELSE event_type END AS type,
  'org' || (user_id % 10) || '/repo' || (user_id % 25) AS name,
  CASE WHEN event_id % 97 = 0 THEN '{broken' ELSE
    '{"action":"' || CASE event_id % 3 WHEN 0 THEN 'opened' WHEN 1 THEN 'closed' ELSE 'reopened' END
    || '","pull_request":{"url":'
    || CASE WHEN event_id % 53 = 0 THEN 'null' WHEN event_id % 59 = 0 THEN '"null"'
       ELSE '"https://api.example.com/repos/org' || (user_id % 10) || '/repo' || (user_id % 25)
         || '/pulls/' || user_id || '"' END
    || ',"patch_url":"https://example.com/org' || (user_id % 10) || '/repo' || (user_id % 25)
    || '/pull/' || user_id || '.patch"},"comment":{"original_position":' || (event_id % 20)
    || ',"position":'
    || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE coalesce(json_extract_string(props, '$.k'), 'null') END
    || ',"commit_id":"' || md5(event_id::VARCHAR) || '","path":'
    || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"src/mod' || (event_id % 50) || '.py"' END
    || ',"body":"note ' || event_id || '","diff_hunk":"@@ -1,2 +1,3 @@\\n a\\n+b' || event_id
    || '"},"issue":{"url":"https://api.example.com/repos/org' || (user_id % 10) || '/repo'
    || (user_id % 25) || '/issues/' || event_id || '"}}' END AS payload
FROM events"""
VIEWS["review"] = """
SELECT event_id, p->>'$.action' AS action, p->>'$.pull_request.url' AS pull_request_url,
  p->>'$.pull_request.patch_url' AS pull_patch_url,
  coalesce(p->>'$.comment.original_position', '-1') AS original_position,
  coalesce(p->>'$.comment.position', '-1') AS position,
  p->>'$.comment.commit_id' AS commit_id, p->>'$.comment.path' AS path,
  p->>'$.comment.body' AS body, p->>'$.comment.diff_hunk' AS diff_hunk
FROM (SELECT event_id, payload::JSON AS p FROM archive
  WHERE type IN ('PullRequestReviewCommentEvent', 'PullRequestEvent2') AND json_valid(payload))
WHERE p->>'$.pull_request.url' IS NOT NULL"""
_GROUPED = """
SELECT pull_request_url, part::INT AS part, min(pull_patch_url) AS pull_patch_url,
  string_agg(position, '¶' ORDER BY event_id) AS comments_positions,
  string_agg(original_position, '¶' ORDER BY event_id) AS comments_original_positions,
  string_agg(commit_id, '¶' ORDER BY event_id) AS comment_commit_ids,
  string_agg(coalesce(path, '∅'), '¶' ORDER BY event_id) AS comment_file_paths,
  string_agg(body, '¶' ORDER BY event_id) AS comment_text,
  string_agg(diff_hunk, '¶' ORDER BY event_id) AS diff_hunks
FROM ({parts}) GROUP BY pull_request_url, part"""
VIEWS["cells"] = """
SELECT pull_request_url, min(pull_patch_url) AS pull_patch_url,
  string_agg(position, ' ' ORDER BY event_id) AS comments_positions_space_delimited,
  string_agg(original_position, ' ' ORDER BY event_id) AS comments_original_positions_space_delimited,
  coalesce('[' || string_agg('"' || path || '"', ',' ORDER BY event_id) || ']', 'null')
    AS comment_file_paths_json_encoded,
  string_agg(commit_id, ' ' ORDER BY event_id) AS comment_commit_ids_space_delimited
FROM review GROUP BY pull_request_url"""
VIEWS["opened_issues"] = """
SELECT name, payload::JSON->>'$.issue.url' AS url FROM archive
WHERE type = 'IssuesEvent' AND json_valid(payload) AND payload::JSON->>'$.action' = 'opened'"""

VIEWS["known"] = """
SELECT * FROM docs WHERE d % 29 <> 3 AND d % 31 <> 4"""
VIEWS["clean"] = """
SELECT k.pr AS pull_request_url, k.page || '.patch' AS pull_patch_url,
  coalesce(string_agg(coalesce(old_at::VARCHAR, '∅'), '¶' ORDER BY j) FILTER (WHERE j IS NOT NULL), '')
    AS old,
  coalesce(string_agg(new_at::VARCHAR, '¶' ORDER BY j), '') AS new,
  coalesce(string_agg(comment_text, '¶' ORDER BY j), '') AS comment_text,
  coalesce(string_agg(hunk, '¶' ORDER BY j), '') AS diff_hunks,
  coalesce(string_agg(filename, '¶' ORDER BY j), '') AS comment_file_paths,
  coalesce(string_agg(commit_id, '¶' ORDER BY j), '') AS comment_commit_ids
FROM known k LEFT JOIN comment_hunks c ON c.d = k.d GROUP BY k.pr, k.page"""
VIEWS["uncached"] = "SELECT * FROM known WHERE d % 17 <> 0"
VIEWS["resolved"] = """
SELECT u.*, p.patch FROM uncached u JOIN patches p ON p.d = u.d
WHERE u.d % 11 <> 0 AND u.d % 13 <> 0"""

VIEWS["pr_events"] = """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 43 = 0 THEN 'not json' ELSE
  '{"action":' || CASE WHEN o_orderkey % 37 = 0 THEN 'null' WHEN o_orderstatus = 'O' THEN '"opened"'
    WHEN o_orderstatus = 'F' THEN '"closed"' ELSE '"reopened"' END
  || ',"number":' || o_orderkey || ',"pull_request":{"url":"https://api.example.com/repos/org'
  || (o_orderkey % 10) || '/repo' || (o_orderkey % 25) || '/pulls/' || o_orderkey
  || '","patch_url":"https://example.com/org' || (o_orderkey % 10) || '/repo' || (o_orderkey % 25)
  || '/pull/' || o_orderkey || '.patch","title":"change ' || o_orderkey || '","number":'
  || o_orderkey || '},"repository":{"name":"repo' || (o_orderkey % 25) || '","full_name":"org'
  || (o_orderkey % 10) || '/repo' || (o_orderkey % 25) || '","owner":{"login":"org'
  || (o_orderkey % 10) || '"}}}' END AS value
FROM orders"""
VIEWS["pr_opened"] = """
SELECT j->>'$.pull_request.url' AS pull_request_url, j->>'$.pull_request.patch_url' AS pull_patch_url,
  j->>'$.repository.full_name' AS repo_name, j->>'$.repository.owner.login' AS owner,
  (j->>'$.pull_request.number')::INT AS number, j->>'$.pull_request.title' AS title
FROM (SELECT value::JSON AS j FROM pr_events WHERE json_valid(value))
WHERE j->>'$.action' = 'opened'"""


def with_views(sql: str) -> str:
    """``sql`` with the views it uses, directly or through others, in front."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"[a-z_0-9]+", pending.pop()))
        for name in words & VIEWS.keys() - needed:
            needed.add(name)
            pending.append(VIEWS[name])
    views = [f"{name} AS ({VIEWS[name]}\n)" for name in VIEWS if name in needed]
    return f"WITH {', '.join(views)}\n{sql}" if views else sql


_RECORD_COLUMNS = """pr AS pull_request_url, previous_lines, line_text, next_lines, filename,
  is_added, commented, line, comment_text"""
_DUMP = """'{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"source":' || to_json(source)
  || ',"text":' || to_json(text) || '}'"""
_CSV_FIELDS = ", ".join(
    f"coalesce('=' || {c}, '~')"
    for c in (
        "pull_request_url",
        "pull_patch_url",
        "comments_positions_space_delimited",
        "comments_original_positions_space_delimited",
        "comment_file_paths_json_encoded",
        "comment_commit_ids_space_delimited",
    )
)
_GREETINGS = f"[{_quoted(GREETINGS)}]"
_PHRASES = f"[{_quoted(tuple(p.format(name='Reviewer') for p in PHRASES))}]"


def _message(key: str) -> str:
    return (
        f"({_GREETINGS})[{_bucket(key, 6)} + 1] || ' ' || "
        f"({_PHRASES})[{_bucket(key + ' || ' + repr('#'), 11)} + 1]"
    )


_HASHED = "docs.pr || ':' || r.filename || ':' || r.position"

_SCORING = f"""
SELECT docs.pr AS pull_request_url, r.line_at, r.text AS line_text, r.filename, r.is_added,
  0.0::DOUBLE AS commented, {_ext("r.filename")} AS extension, length(r.text)::DOUBLE AS line_length,
  0.0::DOUBLE AS label, regexp_matches(r.text, '^\\s+$')::INT::DOUBLE AS only_spaces,
  (NOT EXISTS (SELECT 1 FROM facts f WHERE f.project = docs.project AND f.line = r.old_pos
    AND f.filename = {_base("r.filename")}))::INT::DOUBLE AS not_in_issues,
  r.commit_id, r.position AS "offset", r.previous_lines, r.next_lines
FROM records r JOIN docs ON docs.d = r.k"""

VIEWS["answers"] = f"""
SELECT docs.pr, coalesce(s.positions, '') AS positions,
  CASE WHEN docs.d % 11 = 0 THEN 'no text'
    WHEN docs.d IN (SELECT k FROM records_files WHERE header AND greatest(old0, new0) > 2147483647)
    THEN 'line number does not fit an int' END AS message
FROM docs LEFT JOIN (
  SELECT pr, string_agg(filename || '@' || commit_id || ':' || position, '¶' ORDER BY nth) AS positions
  FROM (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY p1 DESC, filename, position, commit_id)
      AS nth
    FROM (SELECT DISTINCT docs.pr, r.filename, r.position, r.commit_id, {_bucket(_HASHED, 1000)} AS p1
      FROM records r JOIN docs ON docs.d = r.k WHERE docs.d % 11 <> 0) WHERE p1 >= 700)
  WHERE nth <= 7 GROUP BY pr) s ON s.pr = docs.pr"""

SQL: dict[str, str] = {
    "changed_lines_by_extension": f"""
SELECT coalesce({_ext("filename")}, 'other') AS extension, is_added, count(*) AS n_lines,
  count(DISTINCT filename) AS n_files, sum(new_pos)::BIGINT AS sum_new_pos,
  sum(position)::BIGINT AS sum_position, sum(length(text))::BIGINT AS n_chars
FROM records GROUP BY ALL""",
    "changed_lines": """
SELECT k AS patch_id, line_at, commit_id, old_pos, new_pos, position, previous_lines, text,
  next_lines, filename, is_added FROM records""",
    "changed_lines_up_to_2000": """
SELECT k AS patch_id, line_at, length(text)::INT AS n_chars FROM records WHERE length(text) < 2000""",
    "changed_long_lines": """
SELECT k AS patch_id, line_at, position, text, is_added FROM long_records""",
    "changed_lines_short_context": """
SELECT k AS patch_id, line_at, previous_lines, next_lines FROM short_records""",
    "hunk_lines": """
SELECT c.pr AS pull_request_url, c.j::INT AS item, line_at, old_pos, new_pos, position,
  previous_lines, text, next_lines, is_added
FROM hunk_lines r JOIN comment_hunks c ON r.k = c.d || ':' || c.j""",
    "patch_rejects": """
SELECT 'line number does not fit an int' AS error, patch FROM patches
WHERE d IN (SELECT k FROM records_files WHERE header AND greatest(old0, new0) > 2147483647)""",
    "archive_day_scan": """
SELECT day, type, count(*) AS n FROM archive WHERE day LIKE '2024011%' GROUP BY ALL""",
    "archive_month_scan": """
SELECT event_type, count(*) AS n, max(event_id) AS last_event FROM events
WHERE strftime(ts, '%Y%m') = '202401' GROUP BY ALL""",
    "archive_yesterday": "SELECT day, count(*) AS n FROM archive WHERE day = '20240114' GROUP BY ALL",
    "archive_partitions": """
SELECT day, name, count(*) AS n FROM archive WHERE day LIKE '2024010%' GROUP BY ALL""",
    "review_events": """
SELECT event_id, type, day FROM archive
WHERE type = 'PullRequestReviewCommentEvent' OR type = 'PullRequestEvent2'""",
    "undecodable_events": """
SELECT event_id, type, payload FROM archive WHERE NOT json_valid(payload)""",
    "review_comments": "SELECT * FROM review",
    "comments_by_pull_request": _GROUPED.format(parts="SELECT *, 0 AS part FROM review"),
    "comments_in_parts": _GROUPED.format(
        parts=f"""SELECT *, CASE WHEN n > 20
    THEN ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % ceil(n / 20.0)::BIGINT ELSE 0 END AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY pull_request_url) AS n FROM review)"""
    ),
    "comment_cells": "SELECT * FROM cells",
    "comment_cells_first_100": "SELECT * FROM cells ORDER BY pull_request_url LIMIT 100",
    "comment_cells_fingerprint": f"""
SELECT count(*) AS n_rows,
  sum(('0x' || substr(md5(concat_ws(chr(31), {_CSV_FIELDS})), 1, 8))::BIGINT)::BIGINT AS content_id
FROM cells""",
    "comment_cells_through_csv": "SELECT * FROM cells",
    "opened_issues": "SELECT * FROM opened_issues",
    "issue_inputs_through_csv": "SELECT * FROM opened_issues",
    "issue_inputs_through_parquet": "SELECT * FROM opened_issues",
    "missing_days": """
SELECT DISTINCT day FROM archive WHERE day NOT IN (SELECT day FROM archive
  WHERE type = 'IssuesEvent' AND event_id % 2 = 1 AND substr(day, 7, 2) NOT IN ('03', '14', '27'))""",
    "ingested_days": """
SELECT day, count(DISTINCT pull_request_url) AS n_pull_requests, count(*) AS n_comments
FROM review JOIN archive USING (event_id) WHERE day IN ('20240102', '20240103', '20240104')
GROUP BY day""",
    "known_pull_requests": """
SELECT '"' || pr || '"' AS pull_request_url, '"' || page || '.patch"' AS pull_patch_url FROM known""",
    "clean_comments": "SELECT * FROM clean",
    "archive_to_clean_comments": """
SELECT pull_request_url, min(pull_patch_url) AS pull_patch_url,
  string_agg(coalesce(TRY_CAST(original_position AS INT)::VARCHAR, '∅'), '¶' ORDER BY event_id) AS old,
  string_agg(coalesce(TRY_CAST(position AS INT)::VARCHAR, '∅'), '¶' ORDER BY event_id) AS new,
  string_agg(body, '¶' ORDER BY event_id) AS comment_text,
  string_agg(diff_hunk, '¶' ORDER BY event_id) AS diff_hunks,
  string_agg(coalesce(path, '∅'), '¶' ORDER BY event_id) AS comment_file_paths,
  string_agg(commit_id, '¶' ORDER BY event_id) AS comment_commit_ids
FROM review WHERE pull_request_url <> 'null' GROUP BY pull_request_url""",
    "comments_through_json": "SELECT * FROM clean",
    "comments_through_parquet": "SELECT * FROM clean",
    "uncached_pull_requests": """
SELECT pr AS pull_request_url, page || '.patch' AS pull_patch_url FROM uncached""",
    "wanted_urls": """
SELECT page || '.patch' AS url FROM uncached UNION SELECT page || '.diff' FROM uncached""",
    "fetched_responses": """
SELECT url, CASE WHEN url LIKE '%3.patch' THEN 404 WHEN url NOT LIKE '%7.diff' THEN 200 END::INT AS status,
  CASE WHEN url NOT LIKE '%7.diff' THEN 'body of ' || url END AS body,
  CASE WHEN url LIKE '%7.diff' THEN 'OSError: no answer' END AS error
FROM (SELECT page || '.patch' AS url FROM known UNION SELECT page || '.diff' FROM known)""",
    "fetched_again": """
SELECT url, 200::INT AS status, CASE WHEN url LIKE '%7.diff' THEN 'second' ELSE 'first' END AS body
FROM (SELECT page || '.patch' AS url FROM known UNION SELECT page || '.diff' FROM known)""",
    "resolve_patches": """
SELECT r.pr AS pull_request_url, r.page || '.patch' AS pull_patch_url,
  (SELECT count(*) FROM comments c WHERE c.d = r.d)::INT AS n_comments, md5(r.patch) AS patch_md5,
  'diff of ' || r.d AS diff FROM resolved r""",
    "resolve_with_cache": """
SELECT pr AS pull_request_url, kept_as FROM known, unnest(['result', 'cache']) AS t(kept_as)
WHERE d % 11 <> 0 AND d % 13 <> 0""",
    "resolve_with_cache_compat": """
SELECT pr AS pull_request_url FROM known WHERE d % 11 <> 0 AND d % 13 <> 0""",
    "late_comments_on_cached": """
SELECT docs.pr AS pull_request_url, CASE WHEN count(c.j) = 0 THEN 1 ELSE 2 END::BIGINT AS n_rows,
  count(c.j) AS n_comments, 1::BIGINT AS n_patches, 1::BIGINT AS n_cached
FROM docs LEFT JOIN comments c ON c.d = docs.d WHERE docs.d % 11 <> 0 AND docs.d % 13 <> 0 GROUP BY docs.pr""",
    "resolve_issues": """
SELECT project AS name, md5(body) AS body_md5 FROM issue_bodies WHERE d % 19 <> 0""",
    "issue_facts": "SELECT * FROM facts",
    "issue_facts_with_repeats": """
SELECT project, filename, line, count(*) AS n FROM frames GROUP BY ALL""",
    "issue_facts_by_project": "SELECT * FROM facts WHERE project LIKE 'org3/%'",
    "comment_hunks": """
SELECT pr AS pull_request_url, j::INT AS item, hunk, filename AS path, comment_text
FROM comment_hunks""",
    "hunk_records": f"SELECT {_RECORD_COLUMNS}, item, line_at FROM hunk_records",
    "hunk_records_last_line": """
SELECT h.pr AS pull_request_url, h.item, h.line_at, h.line_text
FROM hunk_records h JOIN comment_hunks c ON c.d = h.d AND c.j = h.item
WHERE h.line_at = length(rtrim(c.hunk, chr(10))) - length(replace(rtrim(c.hunk, chr(10)), chr(10), ''))""",
    "commented_lines": """
SELECT docs.pr AS pull_request_url, line_at, commit_id, filename, position
FROM flags JOIN docs ON docs.d = flags.k WHERE hit""",
    "lines_near_comments": """
SELECT docs.pr AS pull_request_url, line_at, filename, position
FROM flags JOIN docs ON docs.d = flags.k WHERE near""",
    "commented_lines_compat": """
SELECT docs.pr AS pull_request_url, line_at, old_pos, new_pos, hit, near
FROM flags_compat f JOIN docs ON docs.d = f.k WHERE hit OR near""",
    "patch_records": f"SELECT {_RECORD_COLUMNS}, line_at FROM patch_records",
    "patch_records_compat": f"SELECT {_RECORD_COLUMNS}, line_at FROM patch_records_compat",
    "distinct_records": f"SELECT DISTINCT {_RECORD_COLUMNS} FROM all_records",
    "records_with_comments": """
SELECT pr AS pull_request_url, source::INT AS source, item, line_at, commented FROM all_records
WHERE pr IN (SELECT pr FROM all_records WHERE commented)""",
    "first_per_text": """
SELECT pr AS pull_request_url, source::INT AS source, item, line_at, line_text, commented
FROM chosen""",
    "labelled_lines": f"SELECT {_RECORD_COLUMNS} FROM labelled",
    "labelled_lines_by_day": f"SELECT {_RECORD_COLUMNS} FROM labelled_by_day",
    "labelled_lines_hot": f"""
SELECT {_RECORD_COLUMNS} FROM hot_chosen WHERE pr IN (SELECT pr FROM hot_records WHERE commented)""",
    "labelled_lines_compat": f"SELECT {_RECORD_COLUMNS} FROM labelled_compat",
    "file_extensions": f"""
SELECT filename, {_base("filename")} AS basename, {_ext("filename")} AS extension
FROM (SELECT filename FROM records UNION SELECT url FROM pages)""",
    "line_features": f"""
SELECT d AS doc_id, i::INT AS at, {_ext("f1")} AS extension, length(line)::DOUBLE AS line_length,
  regexp_matches(line, '^\\s+$')::INT::DOUBLE AS only_spaces,
  regexp_matches(line, '^s+$')::INT::DOUBLE AS only_spaces_compat
FROM (SELECT d, f1, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM docs)""",
    "prepared_training": "SELECT * EXCLUDE (pr) FROM prepared WHERE extension = 'py'",
    "prepared_training_all_files": "SELECT pr AS pull_request_url, * EXCLUDE (pr) FROM prepared",
    "prepared_training_compat": f"""
SELECT l.pr AS pull_request_url, l.line_text, l.line, 1.0::DOUBLE AS label,
  regexp_matches(l.line_text, '^s+$')::INT::DOUBLE AS only_spaces,
  (count(f.filename) = 0)::INT::DOUBLE AS not_in_issues, count(*) AS n
FROM labelled_compat l LEFT JOIN frames f ON f.line = l.line AND f.filename = {_base("l.filename")}
WHERE ({_ext("l.filename")}) = 'py' GROUP BY l.pr, l.line_text, l.line""",
    "prepared_scoring": _SCORING,
    "prepared_scoring_of_projects": f"{_SCORING} WHERE docs.project LIKE 'org3/%'",
    "train_test_split": f"""
SELECT pr AS pull_request_url, CASE WHEN {_bucket("pr", 1000)} < 900 THEN 'train' ELSE 'test' END AS side
FROM docs""",
    "dataset_summary": "SELECT count(*) AS n, sum(label)::BIGINT AS positives FROM prepared",
    "balanced_classes": """
SELECT pr AS pull_request_url, line_text, label, CASE WHEN label = 0 THEN 1 ELSE
  (SELECT ceil(count(*) / sum(label)) FROM prepared) END::BIGINT AS n FROM prepared""",
    "balanced_classes_by_negatives": """
SELECT label, sum(CASE WHEN label = 0 THEN 1 ELSE
  (SELECT ceil(sum(1 - label) / sum(label)) FROM prepared) END)::BIGINT AS n
FROM prepared GROUP BY label""",
    "extension_index": f"""
SELECT extension, (row_number() OVER (ORDER BY count(*) DESC, extension) - 1)::DOUBLE AS extension_index
FROM (SELECT {_ext("filename")} AS extension FROM records) WHERE extension IS NOT NULL
GROUP BY extension""",
    "tokens": """
SELECT token, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS token FROM records)
WHERE token <> '' GROUP BY token""",
    "hashed_words": """
SELECT count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS n_with_words, TRUE AS agree
FROM records""",
    "weighted_classes": """
SELECT label, CASE WHEN label = 0 THEN 1 ELSE (SELECT ceil(count(*) / sum(label)) FROM prepared) END::DOUBLE
  AS weight, count(*) AS n
FROM prepared GROUP BY label""",
    "training_folds": f"""
SELECT pr AS pull_request_url, {_bucket("pr", 3)}::INT AS fold, count(*) AS n FROM prepared GROUP BY ALL""",
    "prep_models": """
SELECT step, step = 'again' AS found, TRUE AS agree, (SELECT count(*) FROM prepared
  WHERE extension IS NOT NULL AND (is_added OR step <> 'other rows')) AS n_rows
FROM (VALUES ('first'), ('again'), ('other options'), ('other rows')) AS t(step)""",
    "model_report": """
SELECT count(*) AS n, sum(label)::BIGINT AS positives, TRUE AS has_pr, TRUE AS has_roc, 2::INT AS n_models
FROM prepared WHERE extension = 'py'""",
    "training_job": """
SELECT count(*) FILTER (WHERE extension = 'py') AS n,
  (sum(label) FILTER (WHERE extension = 'py'))::BIGINT AS positives,
  (SELECT count(DISTINCT k) FROM records_files WHERE header AND greatest(old0, new0) > 2147483647) AS n_rejects,
  count(*) FILTER (WHERE extension = 'py') AS n_scored
FROM prepared""",
    "word_vectors": """
SELECT kind, size, count(*) AS n FROM prepared, (VALUES ('vectors', 10), ('frequencies', 36)) AS t(kind, size)
WHERE extension IS NOT NULL GROUP BY kind, size""",
    "model_suggestions": """
SELECT pr AS pull_request_url, message, TRUE AS all_listed, TRUE AS at_most_seven, TRUE AS ranked,
  TRUE AS lines_exist, TRUE AS saved_agrees
FROM answers""",
    "roc_and_pr_areas": """
SELECT max(n)::BIGINT AS n, max(positives)::BIGINT AS positives,
  round(sum(neg * (tp - pos / 2.0)) / (max(positives)::DOUBLE * (max(n) - max(positives))), 9) AS roc,
  round(sum(pos * (coalesce((tp - pos)::DOUBLE / nullif(tp - pos + fp - neg, 0), tp::DOUBLE / (tp + fp))
    + tp::DOUBLE / (tp + fp)) / 2) / max(positives), 9) AS pr
FROM (SELECT pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos + neg) OVER () AS n, sum(pos) OVER () AS positives
  FROM (SELECT p1, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY p1)
  WINDOW w AS (ORDER BY p1 DESC))""",
    "curve_points": """
SELECT p1 AS score, pos::BIGINT AS pos, neg::BIGINT AS neg,
  (sum(pos) OVER (ORDER BY p1 DESC))::BIGINT AS tp, (sum(neg) OVER (ORDER BY p1 DESC))::BIGINT AS fp
FROM (SELECT p1, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY p1)""",
    "positive_predictions": """
SELECT pr AS pull_request_url, filename, line, commit_id, p1, 1.0::DOUBLE AS prediction FROM positive""",
    "best_per_line": "SELECT pr AS pull_request_url, filename, line, commit_id, p1 FROM best",
    "unplaced_predictions": """
SELECT pr AS pull_request_url, filename, line, p1 FROM best WHERE commit_id IS NULL""",
    "top_suggestions": "SELECT pr AS pull_request_url, filename, line, commit_id, p1, rank FROM top",
    "deduped_suggestions": """
SELECT DISTINCT pr AS pull_request_url, commit_id, filename, line FROM predictions
WHERE commit_id IS NOT NULL""",
    "suggestion_messages": f"""
SELECT pr AS pull_request_url, commit_id || filename || line AS suggestion_key,
  {_message("commit_id || filename || line")} AS message FROM top""",
    "document_messages": f"""
SELECT doc_id, {_message("doc_id::VARCHAR")} AS message FROM documents""",
    "scoring_responses": "SELECT pr AS pull_request_url, positions, message FROM answers",
    "streamed_suggestions": """
SELECT DISTINCT o.pull_request_url, coalesce(a.positions, '') AS positions,
  CASE WHEN a.pr IS NULL THEN 'no text' ELSE a.message END AS message
FROM pr_opened o LEFT JOIN answers a ON a.pr = o.pull_request_url""",
    "streamed_rejects": """
SELECT value FROM pr_events WHERE NOT json_valid(value) OR (k % 43 <> 0 AND k % 37 = 0)""",
    "ingested_days_with_empty_day": """
SELECT t.day, (SELECT count(*) FROM review JOIN archive USING (event_id) WHERE archive.day = t.day) AS n_rows,
  t.run, 1::BIGINT AS n_extracts
FROM (VALUES ('20231231', '0'), ('20240102', '0'), ('20240103', '0'), ('20240104', '1')) AS t(day, run)""",
    "json_dump": f"""
SELECT {_DUMP} AS value FROM documents ORDER BY doc_id LIMIT 50""",
    "json_dump_escaped": f"""
SELECT to_json({_DUMP})::VARCHAR AS value FROM documents ORDER BY doc_id LIMIT 50""",
    "merged_schemas": """
SELECT d AS patch_id, CASE WHEN d % 2 = 1 THEN length(patch) END::INT AS size FROM patches""",
    "opened_pull_requests": "SELECT * FROM pr_opened",
    "rejected_events": """
SELECT k AS order_key, value FROM pr_events
WHERE NOT json_valid(value) OR (k % 43 <> 0 AND k % 37 = 0)""",
    "streamed_pull_requests": "SELECT * FROM pr_opened",
    "streamed_dedupe": """
SELECT pr AS pull_request_url, commit_id, filename, line, sent, (SELECT count(*) FROM (
    SELECT DISTINCT pr, commit_id, filename, line FROM predictions
    WHERE commit_id IS NOT NULL AND line % 2 = 1 AND line % 3 = 0)) AS n_late
FROM (SELECT DISTINCT pr, commit_id, filename, line FROM predictions WHERE commit_id IS NOT NULL),
  (VALUES (0, '12:00'), (1, '18:00'), (0, '18:10')) AS t(odd, sent)
WHERE line % 2 = odd""",
}
SQL["patch_rejects_written"] = SQL["patch_rejects"]


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
