"""SQL for array work that stays linear and inside one row.

Most functions give the text of a SQL expression; their arguments are SQL too.
The arrays already sit in a row, so nothing here moves data between partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def compute_once(df: DataFrame, **columns: str) -> DataFrame:
    """Add columns that are computed once per row, however often they are used.

    A plain ``withColumn`` can be merged into the filters and lambdas that use
    it, and would then run several times; the generator keeps the two apart.
    """
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return df.selectExpr("*", f"inline(array(named_struct({fields}))) AS ({', '.join(columns)})")


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once.

    Without this, Catalyst may inline an expression such as ``split(patch)``
    into a per-element lambda, where it would run again for every line.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def present(array: str) -> str:
    """The array without its nulls."""
    return f"filter({array}, item -> item IS NOT NULL)"


def counts_before(word: str, kind: str) -> str:
    """Running count of one character in a string of one-character kinds.

    Element ``i`` is the number of ``kind`` characters strictly before offset
    ``i``; the array has one more element than the string, so element ``i + 1``
    counts through offset ``i``.  Splitting at the character leaves runs over
    which the count is constant, which makes the whole array linear to build.
    """
    return (
        f"flatten(transform(split({word}, '[{kind}]', -1), "
        "(run, n) -> array_repeat(n, length(run) + 1)))"
    )


def flags_at(marks: str, size: str) -> str:
    """Boolean array of at least ``size`` elements, true at the offsets in ``marks``.

    Offsets outside ``[0, size)`` are ignored.  Sorting the marks and emitting
    the gaps between them costs ``marks + size``, where testing every offset
    with ``array_contains`` would cost their product.
    """
    inside = f"sort_array(filter(array_distinct({marks}), m -> m >= 0 AND m < {size}))"
    gaps = (
        "flatten(transform(slice(stops, 2, size(stops)), (stop, i) -> "
        "concat(array_repeat(false, stop - get(stops, i) - 1), array(true))))"
    )
    return bind(f"concat(array(-1), {inside}, array({size}))", "stops", gaps)


def pieces(lines: str, own: str, opens: str, look: int) -> str:
    """Cut the first ``own`` of ``lines`` before every ``line`` that ``opens`` a piece.

    Gives ``array<struct<at, own, lines>>``: where the piece begins, how many
    lines belong to it, and those lines followed by up to ``look`` lines of
    what comes after, so that a reader of the piece can look ahead.
    """
    starts = present(
        f"transform(slice(all_lines, 1, {own}), (line, i) -> CASE WHEN i = 0 OR {opens} THEN i END)"
    )
    piece = bind(
        f"coalesce(get(starts, k + 1), {own})",
        "stop",
        "named_struct('at', start, 'own', stop - start, "
        f"'lines', slice(all_lines, start + 1, stop - start + {look}))",
    )
    return bind(lines, "all_lines", bind(starts, "starts", f"transform(starts, (start, k) -> {piece})"))
