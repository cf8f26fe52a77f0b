"""Resolving patch, diff and issue texts from a table of responses.

Network access, where it is wanted, fills the response table in one
``mapInPandas`` step; everything else is joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prsignal import schemas
from prsignal.functions.text import diff_url, strip_quote_runs
from prsignal.session import materialize
from prsignal.sources.sinks import append_parquet
from prsignal.sources.tables import read_or_empty

OK = 200
# Fixed value: requests in flight per task.
MAX_IN_FLIGHT = 8
# What a task hands to Spark at once.
PIECE_ROWS, PIECE_BYTES = 256, 8 << 20


def not_cached(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Inputs whose pull request is not in the cache."""
    return inputs.join(cache.select("pull_request_url"), "pull_request_url", "left_anti")


def wanted_urls(inputs: DataFrame) -> DataFrame:
    """The patch and diff urls to fetch, each once."""
    urls = F.array("pull_patch_url", diff_url(F.col("pull_patch_url")))
    return inputs.select(F.explode(urls).alias("url")).where(F.col("url").isNotNull()).distinct()


def resolve_patches(inputs: DataFrame, cache: DataFrame, responses: DataFrame) -> DataFrame:
    """Cleaned comment rows that are not cached, with patch and diff text.

    Rows whose patch or diff did not come back with status 200 are dropped.
    Both joins use the url without its last five characters (four for a diff)
    as their only key, so the second reuses the partitioning of the first and
    no text is shuffled twice.  ``responses`` has one row per url; those that
    end in ``.diff`` are diffs.
    """
    todo = not_cached(inputs, cache).withColumn("stem", _stem(F.col("pull_patch_url")))
    return _with_texts(todo, responses).select(
        "pull_request_url",
        "pull_patch_url",
        F.struct(*schemas.CLEAN_COMMENT_COLUMNS).alias("parsed_input"),
        "patch",
        "diff",
    )


def _without_last(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - n)


def _stem(patch_url: Column) -> Column:
    """A patch url without its last five characters."""
    return _without_last(patch_url, 5)


def _with_texts(todo: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows with ``pull_patch_url`` and its ``stem`` that were answered, with their patch and diff; dealt by ``stem``."""
    good = responses.where(F.col("status") == OK)
    url, is_diff = F.col("url"), F.col("url").endswith(".diff")
    patch_url = F.col("pull_patch_url")
    patches = good.where(~is_diff).select(
        _stem(url).alias("patch_stem"), url.alias("patch_page"), F.col("body").alias("patch")
    )
    diffs = good.where(is_diff).select(
        _without_last(url, 4).alias("diff_stem"), F.col("body").alias("diff")
    )
    # Equal urls, said in a way that adds no second key to the join.
    same_page = F.col("patch_page").startswith(patch_url) & patch_url.startswith(F.col("patch_page"))
    return todo.join(patches, (F.col("stem") == F.col("patch_stem")) & same_page).join(
        diffs, F.col("stem") == F.col("diff_stem")
    )


def resolve_issues(inputs: DataFrame, responses: DataFrame) -> DataFrame:
    """(name, body) of the issues whose page came back with status 200."""
    good = responses.where(F.col("status") == OK).select("url", "body")
    return (
        inputs.withColumn("url", strip_quote_runs(F.col("url")))
        .join(good, "url")
        .select("name", "body")
    )


def stored_patches(resolved: DataFrame) -> DataFrame:
    """Cache rows of resolved pull requests."""
    return resolved.select("pull_request_url", "patch", "diff")


def _digest(comments: Column) -> Column:
    """Tells the comments of one row of a pull request from those of another."""
    return F.sha2(F.to_json(comments), 256)


def _told_apart(inputs: DataFrame) -> DataFrame:
    comments = F.struct(*schemas.CLEAN_COMMENT_COLUMNS)
    return inputs.select("pull_request_url", "pull_patch_url", comments.alias("parsed_input")).withColumn(
        "digest", _digest(F.col("parsed_input"))
    )


def new_rows(inputs: DataFrame, cache: DataFrame, responses: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys of the cleaned comment rows whose texts are known and that ``stored`` does not hold, each once.

    Rows are told apart by pull request and comments.  ``is_new`` says that the
    texts come from the responses and not from the cache, ``for_cache`` that the
    cache gets them from this row, one of its pull request.  No text moves.
    """
    there = stored.select("pull_request_url", _digest(F.col("parsed_input")).alias("digest"))
    kept = cache.select("pull_request_url").distinct().withColumn("is_cached", F.lit(True))
    keys = (
        _told_apart(inputs)
        .select("pull_request_url", "pull_patch_url", "digest")
        .distinct()
        .join(there, ["pull_request_url", "digest"], "left_anti")
        .join(kept, "pull_request_url", "left")
        .withColumn("stem", _stem(F.col("pull_patch_url")))
    )
    columns = ("pull_request_url", "stem", "digest")
    answered = _with_texts(keys.where("is_cached IS NULL"), responses).select(*columns).distinct()
    first = Window.partitionBy("pull_request_url").orderBy("digest")
    fresh = answered.select(
        *columns, F.lit(True).alias("is_new"), (F.row_number().over(first) == 1).alias("for_cache")
    )
    known = keys.where("is_cached").select(
        *columns, F.lit(False).alias("is_new"), F.lit(False).alias("for_cache")
    )
    return fresh.unionByName(known)


def _wanted(keys: DataFrame, by: str) -> DataFrame:
    """One row per ``by`` with the digests that are wanted of it."""
    return keys.groupBy(F.col(by).alias("of")).agg(
        F.collect_set("digest").alias("digests"),
        F.collect_set(F.when(F.col("for_cache"), F.col("digest"))).alias("cache_digests"),
    )


def resolve_rows(
    keys: DataFrame, kinds: set[bool], inputs: DataFrame, cache: DataFrame, responses: DataFrame
) -> DataFrame:
    """The rows at some of the :func:`new_rows`, with patch and diff text.

    Rows and texts are dealt by one key, the stem of the url where the texts come
    from the responses and the pull request where they come from the cache, and
    made distinct where they were joined.  ``kinds`` says of which kinds there
    are keys, by their ``is_new``; the texts of the others are not read.
    """
    rows = _told_apart(inputs)
    columns = ("pull_request_url", "pull_patch_url", "parsed_input", "patch", "diff", "is_new", "for_cache")
    out = []
    if True in kinds:
        todo = rows.withColumn("stem", _stem(F.col("pull_patch_url")))
        todo = todo.join(_wanted(keys.where("is_new"), "stem"), F.col("stem") == F.col("of"))
        in_cache = F.expr("array_contains(cache_digests, digest)").alias("for_cache")
        todo = todo.where("array_contains(digests, digest)").select(*rows.columns, "stem", in_cache)
        fresh = _with_texts(todo, responses).dropDuplicates(["stem", "pull_request_url", "digest"])
        out.append(fresh.withColumn("is_new", F.lit(True)).select(*columns))
    if False in kinds:
        known = rows.join(
            _wanted(keys.where("NOT is_new"), "pull_request_url"), F.col("pull_request_url") == F.col("of")
        ).where("array_contains(digests, digest)")
        texts = cache.select("pull_request_url", "patch", "diff")
        known = known.join(texts, "pull_request_url").dropDuplicates(["pull_request_url", "digest"])
        out.append(known.withColumns({"is_new": F.lit(False), "for_cache": F.lit(False)}).select(*columns))
    return reduce(DataFrame.unionByName, out)


def fetch_and_store(
    inputs: DataFrame,
    cache: DataFrame,
    responses: DataFrame,
    output: str,
    cache_path: str | None = None,
    compat: bool = False,
) -> None:
    """Append newly resolved rows to ``output`` and their texts to the cache.

    Rows are new when ``output`` does not hold them yet, also those of pull
    requests that are in the cache; a run that is repeated, or that follows one
    that failed half way, adds only what is missing.  What is missing is found
    from keys alone, and where it is nothing no text is read.  Rows that go to
    both tables are kept in reliable storage in between, so both get the same
    ones even when executors are lost.  ``compat`` is the older behaviour: what is in the cache
    is left out, later comments on it too.
    """
    if compat:
        resolved = resolve_patches(inputs, cache, responses)
        if cache_path is not None:
            resolved = materialize(resolved)
            append_parquet(stored_patches(resolved), cache_path)
        append_parquet(resolved, output)
        return
    stored = read_or_empty(inputs.sparkSession, output, schemas.RESOLVED)
    keys = materialize(new_rows(inputs, cache, responses, stored))
    kinds = {r.is_new for r in keys.select("is_new").distinct().collect()}
    if not kinds:
        return
    resolved = resolve_rows(keys, kinds, inputs, cache, responses)
    if cache_path is not None and True in kinds:
        resolved = materialize(resolved)
        append_parquet(stored_patches(resolved.where("for_cache")), cache_path)
    append_parquet(resolved.drop("is_new", "for_cache"), output)


def wanted_again(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """The urls that have no answer yet: never asked for, or asked for in vain."""
    answered = responses.where("status IS NOT NULL").select("url")
    return urls.select("url").distinct().join(answered, "url", "left_anti")


def in_completion_order(
    items: Iterable[str], call: Callable[[str], object], max_in_flight: int
) -> Iterator[tuple[str, object, Exception | None]]:
    """(item, result, error) of ``call`` for every item, as they come in.

    At most ``max_in_flight`` calls are open, and no more items are taken than
    that; with 0 they are made one after the other.
    """

    def attempt(item: str) -> tuple[str, object, Exception | None]:
        try:
            return item, call(item), None
        except Exception as error:
            return item, None, error

    if max_in_flight <= 0:
        yield from map(attempt, items)
        return
    items = iter(items)
    with ThreadPoolExecutor(max_in_flight) as pool:
        waiting = {pool.submit(attempt, item) for item in islice(items, max_in_flight)}
        while waiting:
            done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            waiting |= {pool.submit(attempt, item) for item in islice(items, len(done))}
            yield from (future.result() for future in done)


def fetch_responses(
    urls: DataFrame,
    fetch: Callable[[str], tuple[int, str]],
    max_in_flight: int = MAX_IN_FLIGHT,
) -> DataFrame:
    """Fetch every url of ``urls.url`` into a response table with an ``error``.

    ``fetch(url)`` gives (status, body).  Each task has at most ``max_in_flight``
    requests open and holds about ``PIECE_BYTES`` of bodies.  A request that
    raises gives a row without status that says why; :func:`wanted_again` finds
    these for another round.
    """

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_urls = (url for batch in batches for url in batch["url"])
        piece, size = [], 0
        for url, result, error in in_completion_order(all_urls, fetch, max_in_flight):
            status, body = result if error is None else (None, None)
            piece.append((url, status, body, None if error is None else f"{type(error).__name__}: {error}"))
            size += len(body or "")
            if size >= PIECE_BYTES or len(piece) >= PIECE_ROWS:
                yield _piece(piece)
                piece, size = [], 0
        yield _piece(piece)

    return urls.select("url").mapInPandas(rows, schemas.FETCHED)


def _piece(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["url", "status", "body", "error"])
    return out.astype({"status": "Int32"})
