"""Patch parsing: one row per changed line of a unified patch or diff hunk.

The parse needs state (commit, file, hunk, running line numbers), but all of it
lives inside one patch.  A patch is cut into commits, commits into file
sections, and a section into its changed lines, each step an ``inline`` of an
array that is already in the row.  So the whole parse is a narrow
transformation: no shuffle, no sort, no window, and no requirement that patch
ids be unique.  One file section is the unit of work of the last step, so the
cost of a patch is linear in its length.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prsignal.functions.arrays import bind, compute_once, counts_before, flags_at, pieces, present

# The line patterns of the patch format.  A line is classified by
# the first pattern that matches all of it; "." does not match \r, U+0085,
# U+2028 or U+2029, so a body line that ends in \r is not a body line.
DIFF_COMMAND = r"\Adiff --git a/.* b/(.*)\z"
COMMIT_LINE = r"\AFrom\s([A-Za-z0-9]+)\s.*\z"
OLD_FILE = r"\A---\sa/(.+)\s?\z"
NEW_FILE = r"\A\+\+\+\sb/(.+)\s?\z"
HUNK_HEADER = r"\A@@ -(\d+),\d+ \+(\d+),\d+ @@.*\z"
BODY_LINE = r"\A[-+\s].*\z"
CONTEXT_LINE = r"\A\s.*\z"
# Default context of a record, and the length (its sign included)
# beyond which the described job leaves a changed line out.
CONTEXT_LINES = 4
DESCRIBED_MAX_LENGTH = 2000

# Hunk headers of the strict mode may leave out their counts.
STRICT_HUNK_HEADER = r"\A@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@.*\z"


def _is(line: str, prefix: str, pattern: str) -> str:
    """Full match, with a cheap byte comparison in front of the pattern."""
    return f"(startswith({line}, '{prefix}') AND {line} RLIKE r'{pattern}')"


def _opens_commit(line: str = "line") -> str:
    return _is(line, "From", COMMIT_LINE)


def _opens_file(line: str = "line") -> str:
    return _is(line, "diff --git a/", DIFF_COMMAND)


def _header(strict: bool) -> str:
    return STRICT_HUNK_HEADER if strict else HUNK_HEADER


def _kind(strict: bool) -> str:
    """h = hunk header, + - and blank = body line, x = anything else."""
    signature = "WHEN line = '-- ' THEN 'x'" if strict else ""
    return f"""CASE {signature}
        WHEN {_is("line", "@@ -", _header(strict))} THEN 'h'
        WHEN {_is("line", "+", BODY_LINE)} THEN '+'
        WHEN {_is("line", "-", BODY_LINE)} THEN '-'
        WHEN line RLIKE r'{CONTEXT_LINE}' THEN ' '
        ELSE 'x' END"""


def _shown() -> str:
    """Text of a line when it may appear among the lines that follow a record.

    This looks at the line alone: ``+++ b/x`` counts as an added line here, and
    ``--- a/x`` as a file header, wherever they stand.
    """
    return (
        f"CASE WHEN line RLIKE r'{BODY_LINE}' AND NOT {_is('line', '---', OLD_FILE)} "
        "THEN substring(line, 2) END"
    )


def _lines(text_col: str, strict: bool) -> str:
    text = f"`{text_col}`"
    if strict:
        text = f"regexp_replace({text}, r'\\r(?=\\n|\\z)', '')"
    return f"split({text}, '\\n', -1)"


def _mode(hunk_mode: bool | str) -> str:
    return f"`{hunk_mode}`" if isinstance(hunk_mode, str) else str(hunk_mode)


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _reason(lines: str, hunk_mode: bool | str, strict: bool) -> str:
    """Why a patch of these lines cannot be parsed, or null.

    A header whose line number does not fit an int is an error where headers
    count: after a ``diff`` command, and everywhere in hunk mode.  In hunk mode
    a header between a commit line and the next ``diff`` command has no
    position to count from.
    """
    header = _header(strict)
    number = f"try_cast(regexp_extract(line, r'{header}', {{}}) AS INT)"
    # d = diff command, c = commit line, h/o = header that fits / overflows.
    kind = f"""CASE WHEN {_opens_file()} THEN 'd' WHEN {_opens_commit()} THEN 'c'
        WHEN {_is("line", "@@ -", header)} THEN
            CASE WHEN {number.format(1)} IS NULL OR {number.format(2)} IS NULL THEN 'o' ELSE 'h' END
        ELSE '' END"""
    mode = _mode(hunk_mode)
    return bind(
        f"array_join(transform({lines}, line -> {kind}), '')",
        "word",
        f"""CASE
            WHEN word RLIKE 'd[dho]*o' OR ({mode} AND word RLIKE 'o')
                THEN 'line number does not fit an int'
            WHEN {mode} AND word RLIKE 'c[cho]*[ho]' THEN 'header without a position' END""",
    )


def _sections_and_rejects(
    df: DataFrame, text_col: str, hunk_mode: bool | str, look: int, strict: bool
) -> DataFrame:
    """File sections of the patches that parse, and one row with an ``error`` for each that does not.

    A text is split once, both for the check and for the cut.
    """
    keep = _quoted([c for c in df.columns if c != text_col])
    empty = "CAST(array() AS array<string>)"

    def or_error(found: str, error: str) -> str:
        return (
            f"CASE WHEN {error} IS NULL THEN {found} "
            f"ELSE array(named_struct('at', 0, 'own', 0, 'lines', {empty})) END"
        )

    cut = bind(
        _reason("patch_lines", hunk_mode, strict),
        "error",
        "named_struct('error', error, 'commits', "
        + or_error(pieces("patch_lines", "size(patch_lines)", _opens_commit(), look), "error")
        + ")",
    )
    commits = compute_once(
        df.where(F.col(text_col).isNotNull()), cut=bind(_lines(text_col, strict), "patch_lines", cut)
    ).selectExpr(*keep, "cut.error AS error", "inline(cut.commits) AS (commit_at, commit_own, commit_lines)")
    return commits.selectExpr(
        *keep,
        "error",
        "commit_at",
        f"CASE WHEN {_opens_commit('get(commit_lines, 0)')} "
        f"THEN regexp_extract(commit_lines[0], r'{COMMIT_LINE}', 1) END AS commit_id",
        "inline("
        + or_error(pieces("commit_lines", "commit_own", _opens_file(), look), "error")
        + ") AS (file_at, own, lines)",
    )


def file_sections(
    df: DataFrame,
    text_col: str = "patch",
    *,
    hunk_mode: bool | str = False,
    next_lines: int = CONTEXT_LINES,
    strict: bool = False,
) -> DataFrame:
    """One row per file section of a patch, next to the other columns of ``df``.

    Adds ``commit_id``, ``filename``, ``first_position`` and the section's
    lines.  Patches that cannot be parsed give nothing (see :func:`split_rejects`).
    In ``hunk_mode`` the text is a bare hunk, so lines before any ``diff``
    command count as well; the name of a boolean column decides row by row.
    """
    rows = _sections_and_rejects(df, text_col, hunk_mode, max(next_lines - 1, 0), strict)
    keep = _quoted([c for c in df.columns if c != text_col])
    sections = rows.where("error IS NULL")
    opened = _opens_file("lines[0]")
    sections = sections.where(f"{opened} OR {_mode(hunk_mode)}")
    # The last "+++ b/" line before the first hunk header names the file.
    names = f"""transform(
        filter(slice(lines, 1, CASE WHEN header_at > 0 THEN header_at - 1 ELSE own END),
               line -> {_is("line", "+++", NEW_FILE)}),
        line -> regexp_extract(line, r'{NEW_FILE}', 1))"""
    header_at = f"array_position(transform(slice(lines, 1, own), line -> {_is('line', '@@ -', _header(strict))}), true)"
    filename = bind(
        f"CAST({header_at} AS INT)",
        "header_at",
        f"element_at(concat(array(regexp_extract(lines[0], r'{DIFF_COMMAND}', 1)), {names}), -1)",
    )
    return sections.selectExpr(
        *keep,
        "commit_id",
        f"CASE WHEN {opened} THEN {filename} END AS filename",
        # A commit line leaves no position to count from until a diff command.
        f"CASE WHEN {opened} THEN -1 WHEN commit_id IS NULL THEN 0 END AS first_position",
        "commit_at + file_at AS section_at",
        "own",
        "lines",
    )


def changed_lines(
    sections: DataFrame,
    *,
    marks: Mapping[str, str] | None = None,
    line_marks: Mapping[str, str] | None = None,
    only: str | None = None,
    previous_lines: int = CONTEXT_LINES,
    next_lines: int = CONTEXT_LINES,
    max_length: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row per added or removed line of :func:`file_sections`.

    ``marks`` maps an output name to a column with an ``array<int>`` of
    positions; the output has a boolean column of that name instead, true where
    the line's position is in the array.  ``line_marks`` does the same with the
    ``line_at`` of lines, and ``only`` names a column with the ``line_at`` of the
    lines that are wanted.  ``max_length`` leaves out changed lines that are
    longer, their sign included; by default none is left out.
    """
    marks, line_marks = dict(marks or {}), dict(line_marks or {})
    at_lines = line_marks | ({"_only": only} if only else {})
    used = ("commit_id", "filename", "first_position", "section_at", "own", "lines", *marks.values(), *at_lines.values())
    keep = _quoted([c for c in sections.columns if c not in used])
    header = _header(strict)
    short = "" if max_length is None else f"AND length(lines[i]) <= {max_length}"
    wanted = "AND get(at__only, i)" if only else ""

    # Nothing counts before the first hunk header of a section.
    kinds = bind(
        f"transform(slice(lines, 1, own), line -> {_kind(strict)})",
        "raw",
        bind(
            "CAST(array_position(raw, 'h') AS INT)",
            "header_at",
            "transform(raw, (kind, i) -> "
            "CASE WHEN header_at > 0 AND i >= header_at - 1 THEN kind ELSE 'x' END)",
        ),
    )
    work = compute_once(sections, kinds=kinds)
    work = compute_once(
        work,
        **{
            f"at_{name}": flags_at(f"transform({at}, line_at -> line_at - section_at)", "size(kinds)")
            for name, at in at_lines.items()
        },
        hunks=counts_before("array_join(kinds, '')", "h"),
        adds=counts_before("array_join(kinds, '')", "+"),
        dels=counts_before("array_join(kinds, '')", "-"),
        ctxs=counts_before("array_join(kinds, '')", " "),
    )
    header_lines = present("transform(kinds, (kind, i) -> CASE WHEN kind = 'h' THEN i END)")
    number = f"CAST(regexp_extract(lines[i], r'{header}', {{}}) AS BIGINT) - 1"
    work = compute_once(
        work,
        # Line numbers before each hunk, and the counts reached at its header.
        starts=f"""transform({header_lines}, i -> named_struct(
            'old', {number.format(1)}, 'new', {number.format(2)},
            'adds', adds[i], 'dels', dels[i], 'ctxs', ctxs[i],
            'first', adds[i] + dels[i] + ctxs[i]))""",
        # Texts of the added, removed and context lines.
        body=present(
            "transform(kinds, (kind, i) -> "
            "CASE WHEN kind IN ('+', '-', ' ') THEN substring(lines[i], 2) END)"
        ),
        changed=present(
            f"transform(kinds, (kind, i) -> CASE WHEN kind IN ('+', '-') {short} {wanted} THEN i END)"
        ),
        **{f"at_{name}": flags_at(at, "size(kinds) + 1") for name, at in marks.items()},
    )

    # The counts through line i and those at the header of its hunk.
    at_line = """transform(changed, i -> named_struct(
        'line_at', i, 'hunk', hunks[i], 'adds', adds[i + 1], 'dels', dels[i + 1],
        'ctxs', ctxs[i + 1], 'start', starts[hunks[i] - 1]))"""
    nth = "(n.adds + n.dels + n.ctxs)"
    following = present(f"transform(slice(lines, n.line_at + 1, {next_lines}), line -> {_shown()})")
    flags = "".join(
        f", '{name}', coalesce(get(at_{name}, first_position + n.hunk + {nth}), false)"
        for name in marks
    ) + "".join(f", '{name}', get(at_{name}, n.line_at)" for name in line_marks)
    marks = [*marks, *line_marks]
    rows = work.selectExpr(
        *keep,
        "commit_id",
        "filename",
        "first_position",
        "section_at",
        f"""inline(transform({at_line}, n -> named_struct(
            'n', n,
            'previous_lines', slice(body, greatest({nth} - {previous_lines}, n.start.first) + 1,
                                    least({previous_lines}, {nth} - n.start.first)),
            'line', lines[n.line_at],
            'next_lines', {following}
            {flags}))) AS ({", ".join(("n", "previous_lines", "line", "next_lines", *marks))})""",
    )

    def position_from(start: str, one: str) -> str:
        # The low 32 bits, so that line numbers wrap instead of failing.
        number = f"n.start.{start} + (n.{one} - n.start.{one}) + (n.ctxs - n.start.ctxs)"
        return f"CAST(shiftright(shiftleft({number}, 32), 32) AS INT)"

    # The plain arithmetic runs on the exploded rows, in generated code.
    return rows.selectExpr(
        *keep,
        "section_at + n.line_at AS line_at",
        "commit_id",
        position_from("old", "dels") + " AS old_pos",
        position_from("new", "adds") + " AS new_pos",
        f"first_position + n.hunk + {nth} AS position",
        "previous_lines",
        "substring(line, 2) AS text",
        "next_lines",
        "filename",
        "startswith(line, '+') AS is_added",
        *marks,
    )


def split_rejects(
    df: DataFrame, text_col: str = "patch", *, hunk_mode: bool | str = False, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(patches that parse, patches that do not with an ``error`` column)."""
    found = _reason(_lines(text_col, strict), hunk_mode, strict)
    reason = F.expr(f"CASE WHEN `{text_col}` IS NULL THEN 'no text' ELSE {found} END")
    ok = df.where(reason.isNull())
    bad = df.withColumn("error", reason).where(F.col("error").isNotNull())
    return ok, bad


def rejected_patches(df: DataFrame, text_col: str = "patch", **options) -> DataFrame:
    """(patch, error) rows of the patches that cannot be parsed."""
    return split_rejects(df, text_col, **options)[1].select(F.col(text_col).alias("patch"), "error")


def parse_patches(
    df: DataFrame,
    id_cols: Sequence[str] = ("patch_id",),
    text_col: str = "patch",
    *,
    hunk_mode: bool = False,
    previous_lines: int = CONTEXT_LINES,
    next_lines: int = CONTEXT_LINES,
    max_length: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row per changed line: ``id_cols``, ``line_at`` and the record fields.

    ``previous_lines`` and ``next_lines`` include the line itself.  ``strict``
    takes headers without counts, drops the ``\\r`` of CRLF lines and does not
    read the mail signature line ``-- `` as a removed line.  ``max_length``
    leaves out longer changed lines; by default all are kept.
    """
    texts = df.select(*id_cols, text_col)
    sections = file_sections(texts, text_col, hunk_mode=hunk_mode, next_lines=next_lines, strict=strict)
    return changed_lines(
        sections,
        previous_lines=previous_lines,
        next_lines=next_lines,
        max_length=max_length,
        strict=strict,
    )
