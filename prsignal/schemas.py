"""Fixed schemas of the tables the jobs read and write, as DDL texts."""

from __future__ import annotations

ARCHIVE_EVENT = (
    "event_id bigint, type string, repo struct<name:string>, payload string, day string"
)

RAW_COMMENTS = (
    "pull_patch_url string, created_date string, pull_request_url string, "
    "comment_positions array<map<string,string>>, comment_text array<string>, "
    "diff_hunks array<string>, comment_commit_ids array<string>, comment_file_paths array<string>"
)

CLEAN_COMMENTS = (
    "pull_request_url string, pull_patch_url string, "
    "comment_positions array<struct<original_position:int,new_position:int>>, "
    "comment_text array<string>, diff_hunks array<string>, "
    "comment_file_paths array<string>, comment_commit_ids array<string>"
)
CLEAN_COMMENT_COLUMNS = (
    "pull_request_url",
    "pull_patch_url",
    "comment_positions",
    "comment_text",
    "diff_hunks",
    "comment_file_paths",
    "comment_commit_ids",
)

# One row per review comment; ``item`` orders the comments of a pull request within a day.
COMMENT = (
    "pull_request_url string, filename string, commit_id string, original_position int, "
    "new_position int, comment_text string, hunk string, day string, item bigint, "
    "has_hunk boolean, has_position boolean, has_commit boolean"
)

# A finished day of a daily table.
LEDGER = "day string, n_rows bigint, run string"

STORED_PATCH = "pull_request_url string, patch string, diff string"

RESOLVED = (
    "pull_request_url string, pull_patch_url string, "
    f"parsed_input struct<{CLEAN_COMMENTS}>, patch string, diff string"
)

ISSUE_INPUT = "name string, url string"
ISSUE_FACT = "project string, filename string, line int"
RESPONSE = "url string, status int, body string"
# A response table as it is fetched; without status where there was no answer.
FETCHED = f"{RESPONSE}, error string"

# Payload of an archive event; only the fields the extracts use are decoded.
EVENT_PAYLOAD = (
    "action string, "
    "pull_request struct<url:string,patch_url:string>, "
    "comment struct<original_position:string,position:string,commit_id:string,path:string,"
    "body:string,diff_hunk:string,created_at:string>, "
    "issue struct<url:string>"
)

PULL_REQUEST_EVENT = (
    "action string, number int, "
    "pull_request struct<url:string,patch_url:string,title:string,number:int>, "
    "repository struct<name:string,full_name:string,owner:struct<login:string>>"
)
