"""Labelling changed lines by review comments.

Comments are rows of a table of their own (see ``comments.py``), patches of
another.  What the comments of a file point at is summed up per file and joined
to the file's section of the patch, before the section is cut into lines: its
text moves once, its lines with their context not at all, and there is no
join per line.

Comment positions count from the first hunk header of a file, like the
``position`` of a changed line.  A line that a comment points at is a positive,
a line next to one is left out, any other line is a negative.  The negatives
are what the labels are for, as far as the description of the data goes;
``compat=True`` keeps the older behaviour instead: it compares positions with
file line numbers, keeps the lines next to a comment (as positives), and has no
negatives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prsignal.operators.comments import comments_of_rows, file_marks
from prsignal.operators.patch import changed_lines, file_sections
from prsignal.session import materialize

LABELLED_COLUMNS = (
    "pull_request_url",
    "previous_lines",
    "line_text",
    "next_lines",
    "filename",
    "is_added",
    "commented",
    "line",
    "commit_id",
    "offset",
    "comment_text",
    "source",
    "item",
    "line_at",
)
# Sources of a record; hunk records come first.
FROM_HUNK, FROM_PATCH = 0, 1


def zip_shortest(**arrays: Column) -> Column:
    """Array of structs by index, as long as the shortest array; a null array has no items."""
    filled = {name: F.coalesce(a, F.array()) for name, a in arrays.items()}
    sizes = [F.size(a) for a in filled.values()]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    return F.slice(F.arrays_zip(*(a.alias(n) for n, a in filled.items())), F.lit(1), shortest)


def comment_hunks(resolved: DataFrame) -> DataFrame:
    """One row per review comment that has a hunk, a path and a text, by index."""
    parsed = F.col("parsed_input")
    items = zip_shortest(
        hunk=parsed["diff_hunks"],
        path=parsed["comment_file_paths"],
        comment_text=parsed["comment_text"],
    )
    return resolved.select("pull_request_url", F.posexplode(items).alias("item", "i")).select(
        "pull_request_url", "item", "i.hunk", "i.path", "i.comment_text"
    )


def _hunks(comments: DataFrame) -> DataFrame:
    return comments.where("has_hunk").select(
        "pull_request_url", "day", "item", "hunk", F.col("filename").alias("path"), "comment_text"
    )


def records_of_hunks(comments: DataFrame, last_line_only: bool = False) -> DataFrame:
    """Every changed line of a comment's hunk, as commented.

    A hunk ends at the line its comment is on; ``last_line_only`` keeps that
    line alone.
    """
    ok = _hunks(comments).withColumn("last", F.size(F.split(F.rtrim(F.col("hunk"), F.lit("\n")), "\n", -1)) - 1)
    lines = changed_lines(file_sections(ok, "hunk", hunk_mode=True))
    if last_line_only:
        lines = lines.where(F.col("line_at") == F.col("last"))
    return _hunk_records(lines)


def _hunk_records(lines: DataFrame, *more: str) -> DataFrame:
    return lines.select(
        "pull_request_url",
        "previous_lines",
        F.col("text").alias("line_text"),
        "next_lines",
        F.col("path").alias("filename"),
        "is_added",
        F.lit(True).alias("commented"),
        F.col("old_pos").alias("line"),
        F.lit(None).cast("string").alias("commit_id"),
        F.lit(None).cast("int").alias("offset"),
        "comment_text",
        F.lit(FROM_HUNK).alias("source"),
        "day",
        "item",
        "line_at",
        *more,
    )


def hunk_records(resolved: DataFrame, last_line_only: bool = False) -> DataFrame:
    """:func:`records_of_hunks` of the comments of nested rows."""
    return records_of_hunks(comments_of_rows(resolved), last_line_only)


def _url_key(url: Column) -> Column:
    """A url that equals itself in a join, also when it is null, and is told from all others."""
    return F.coalesce(F.concat(F.lit("="), url), F.lit(""))


def newest_patches(resolved: DataFrame, newest_by: str | None = None) -> DataFrame:
    """(url_key, pull_request_url, patch, has_comment) of each pull request, once.

    Of several rows the one with the greatest ``newest_by`` counts, of equal
    ones that with the greatest patch; rows without a patch come last.  Patches
    are grouped by a key that is never null: joins on it find them where they
    are, and no join can ask for a part of them only, so within one job all
    readers share the exchange.
    """
    parsed = F.col("parsed_input")
    any_comment = (F.coalesce(F.size(parsed["diff_hunks"]), F.lit(0)) > 0) | (
        F.coalesce(F.size(parsed["comment_positions"]), F.lit(0)) > 0
    )
    newest = F.col(newest_by) if newest_by else F.lit(0)
    # The greatest of these holds the patch that counts, once.
    rank = F.struct(F.col("patch").isNotNull(), newest.alias("newest"), "patch")
    return resolved.groupBy(_url_key(F.col("pull_request_url")).alias("url_key")).agg(
        F.max("pull_request_url").alias("pull_request_url"),
        F.max(rank)["patch"].alias("patch"),
        F.bool_or(any_comment).alias("has_comment"),
    )


# Columns of patches that their lines have too; the last one only where a patch is looked up again.
_OF_PATCH = ("pull_request_url", "patch", "text_key")


def flagged_lines(patches: DataFrame, comments: DataFrame, **context: int) -> DataFrame:
    """Changed lines of (pull_request_url, patch) with the flags ``hit`` and ``near``.

    ``hit`` says that a comment on the line's commit points at it, ``near`` that
    one on any commit points at it or next to it.
    """
    sections = file_sections(patches.select(*(c for c in patches.columns if c in _OF_PATCH)))
    marked = sections.join(file_marks(comments), ["pull_request_url", "filename"], "left").selectExpr(
        *sections.columns,
        "transform(filter(coalesce(hits, array()), h -> h.commit_id <=> commit_id), h -> h.at) AS hit_at",
        "flatten(transform(coalesce(points, array()), p -> array(p - 1, p, p + 1))) AS near_at",
    )
    return changed_lines(marked, marks={"hit": "hit_at", "near": "near_at"}, **context)


def comment_marks(resolved: DataFrame) -> DataFrame:
    """One row per comment: pull request, file, commit (null if none by index), positions."""
    return comments_of_rows(resolved).where("has_position").select(
        "pull_request_url", "filename", "commit_id", "has_commit", "original_position", "new_position"
    )


_NO_COMMIT = "\u0000"


def _commit_key(commit: Column) -> Column:
    """A commit id that equals itself in a join, also when it is null."""
    return F.coalesce(commit, F.lit(_NO_COMMIT))


def _exact_keys(comments: DataFrame, position: str) -> DataFrame:
    """Distinct (pull request, file, commit, position) that a comment points at."""
    on_commit = comments.where("has_commit") if "has_commit" in comments.columns else comments
    return (
        on_commit.select(
            "pull_request_url",
            "filename",
            _commit_key(F.col("commit_id")).alias("commit_key"),
            F.col(position).alias("at"),
        )
        .where(F.col("at").isNotNull())
        .distinct()
    )


def _near_keys(comments: DataFrame, reach: int = 1) -> DataFrame:
    """Distinct (pull request, file, position) within ``reach`` of a comment, on any commit."""
    around = F.array(
        *(F.col(p) + d for p in ("original_position", "new_position") for d in range(-reach, reach + 1))
    )
    return (
        comments.select("pull_request_url", "filename", F.explode(around).alias("at"))
        .where(F.col("at").isNotNull())
        .distinct()
    )


def _semi_flag(lines: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: whether the line's key is among the distinct ``keys``."""
    return lines.join(keys.withColumn(name, F.lit(True)), list(on), "left").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def flag_commented_lines(
    lines: DataFrame,
    comments: DataFrame,
    *,
    compat: bool = False,
    reach: int = 1,
    flags: Sequence[str] = ("hit", "near"),
) -> DataFrame:
    """Add ``hit`` and ``near`` to changed lines by joining a table of comments.

    Each flag is a join of its own; ``flags`` names the ones that are wanted.

    For comments that live in a table of their own: an equi-join on pull
    request, file and position against distinct keys, where the band of
    ``reach`` positions is spelled out on the side of the comments.  No line is
    duplicated and no group gathered.
    """
    lines = lines.withColumn("commit_key", _commit_key(F.col("commit_id")))
    exact_on = ["pull_request_url", "filename", "commit_key", "at"]
    near_on = ["pull_request_url", "filename", "at"]
    near = _near_keys(comments, reach)
    if not compat:
        both = _exact_keys(comments, "new_position").union(
            _exact_keys(comments, "original_position")
        )
        flagged = lines.withColumn("at", F.col("position"))
        if "hit" in flags:
            flagged = _semi_flag(flagged, both.distinct(), exact_on, "hit")
        if "near" in flags:
            flagged = _semi_flag(flagged, near, near_on, "near")
        return flagged.drop("at", "commit_key")
    # Positions are compared with file line numbers, old with old and new with new.
    flagged = lines
    for i, (own, theirs) in enumerate(
        (("new_pos", "new_position"), ("old_pos", "original_position"))
    ):
        flagged = flagged.withColumn("at", F.col(own))
        flagged = _semi_flag(flagged, _exact_keys(comments, theirs), exact_on, f"hit{i}")
        flagged = _semi_flag(flagged, near, near_on, f"near{i}")
    return flagged.withColumns(
        {"hit": F.col("hit0") | F.col("hit1"), "near": F.col("near0") | F.col("near1")}
    ).drop("at", "commit_key", "hit0", "hit1", "near0", "near1")


def records_of_patches(patches: DataFrame, comments: DataFrame, compat: bool = False) -> DataFrame:
    """Labelled lines of patches (one row per pull request).

    ``compat`` gives the lines near a comment but not exactly on one, all as
    commented; otherwise hits are positives and lines away from any comment
    negatives.
    """
    if compat:
        return _cut_patches(_patches_at(_places_of_patches(patches, comments, compat=True), patches))
    return _patch_records(_labelled_of_flagged(flagged_lines(patches, comments)))


def _labelled_of_flagged(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("hit") | ~F.col("near")).withColumn("commented", F.col("hit"))


def _patch_records(lines: DataFrame, *more: str) -> DataFrame:
    return lines.select(
        "pull_request_url",
        "previous_lines",
        F.col("text").alias("line_text"),
        "next_lines",
        "filename",
        "is_added",
        "commented",
        F.col("old_pos").alias("line"),
        F.lit(None).cast("string").alias("commit_id"),
        F.lit(None).cast("int").alias("offset"),
        F.lit("").alias("comment_text"),
        F.lit(FROM_PATCH).alias("source"),
        F.lit("").alias("day"),
        F.lit(0).cast("bigint").alias("item"),
        "line_at",
        *more,
    )


# -- places of records -----------------------------------------------------
#
# A record has its line up to nine times over, in its context too.  Where records
# are compared or chosen, their places move instead: the key of the text (patch
# or hunk) a record is cut from, its ``line_at``, and a digest of what is
# compared.  The records that remain are then cut from their texts.


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


def _key_of_hunk() -> Column:
    """Tells hunks apart by all that their records show of them and of their comment."""
    return _digest(F.to_json(F.struct("pull_request_url", "day", "item", "path", "comment_text", "hunk")))


def _key_of_patch() -> Column:
    """Tells several patches of one pull request apart."""
    return _digest(F.col("patch"))


def _as_places(records: DataFrame, whole: bool) -> DataFrame:
    """Records with a digest in the place of their line, and of their context if it is ``whole``; else without it."""
    context = F.to_json(F.struct("previous_lines", "line_text", "next_lines"))
    line = context if whole else F.col("line_text")
    return records.withColumn("line_text", _digest(line)).drop("previous_lines", "next_lines", "commit_id", "offset")


def _places_of_hunks(comments: DataFrame, whole: bool = False) -> DataFrame:
    context = {} if whole else {"previous_lines": 0, "next_lines": 0}
    hunks = _hunks(comments).withColumn("text_key", _key_of_hunk())
    lines = changed_lines(file_sections(hunks, "hunk", hunk_mode=True), **context)
    return _as_places(_hunk_records(lines, "text_key"), whole)


def _places_of_patches(patches: DataFrame, comments: DataFrame, compat: bool = False, whole: bool = False) -> DataFrame:
    context = {} if whole else {"previous_lines": 0, "next_lines": 0}
    keyed = patches.select("pull_request_url", "patch", _key_of_patch().alias("text_key"))
    if not compat:
        flagged = _labelled_of_flagged(flagged_lines(keyed, comments, **context))
        return _as_places(_patch_records(flagged, "text_key"), whole)
    lines = changed_lines(file_sections(keyed), **context)
    places = _as_places(
        _patch_records(
            lines.withColumn("commented", F.lit(True)), "text_key", "old_pos", "new_pos", F.col("commit_id").alias("commit")
        ),
        whole,
    ).withColumnRenamed("commit", "commit_id")
    # Lines that are near a comment are of files that have one.
    positions = comments.where("has_position")
    of_files = positions.select("pull_request_url", "filename").distinct()
    places = places.join(of_files, ["pull_request_url", "filename"], "left_semi")
    flagged = flag_commented_lines(places, positions, compat=True).where(F.col("near") & ~F.col("hit"))
    return flagged.drop("old_pos", "new_pos", "commit_id", "hit", "near")


def places(patches: DataFrame, comments: DataFrame, compat: bool = False, whole: bool = False) -> DataFrame:
    """The places of :func:`records`: a digest as ``line_text``, no context, and the ``text_key`` to cut them again."""
    return _places_of_hunks(comments, whole).unionByName(_places_of_patches(patches, comments, compat, whole))


def _first_copy(texts: DataFrame, *keys: str) -> DataFrame:
    """Texts of equal keys once; they are sorted by these keys where they were joined."""
    window = Window.partitionBy(*keys).orderBy("text_key")
    return texts.withColumn("nth", F.row_number().over(window)).where("nth = 1").drop("nth")


def _hunks_at(places: DataFrame, comments: DataFrame) -> DataFrame:
    wanted = places.groupBy("text_key").agg(F.collect_list("line_at").alias("wanted"))
    hunks = _hunks(comments).withColumn("text_key", _key_of_hunk()).join(wanted, "text_key")
    return _first_copy(hunks, "text_key").withColumn("source", F.lit(FROM_HUNK)).withColumnRenamed("hunk", "text")


def _patches_at(places: DataFrame, patches: DataFrame) -> DataFrame:
    found = F.collect_list(F.struct("text_key", "line_at", "commented")).alias("found")
    wanted = places.groupBy(_url_key(F.col("pull_request_url")).alias("url_key")).agg(found)
    if "url_key" not in patches.columns:
        patches = patches.withColumn("url_key", _url_key(F.col("pull_request_url")))
    texts = patches.where("patch IS NOT NULL").select("url_key", "pull_request_url", "patch")
    joined = texts.join(wanted, "url_key").withColumn("text_key", _key_of_patch())
    return _first_copy(joined, "url_key", "text_key").selectExpr(
        "pull_request_url",
        "patch AS text",
        "transform(filter(found, f -> f.text_key = text_key), f -> f.line_at) AS wanted",
        "transform(filter(found, f -> f.text_key = text_key AND f.commented), f -> f.line_at) AS positives",
        f"{FROM_PATCH} AS source",
    )


def texts_at(places: DataFrame, patches: DataFrame, comments: DataFrame) -> DataFrame:
    """The patches and hunks, as ``text``, that some of the :func:`places` lie in, with the lines that are ``wanted``.

    Hunks move by their key and patches by their pull request.
    """
    from_hunk = F.col("source") == FROM_HUNK
    hunks = _hunks_at(places.where(from_hunk), comments).drop("text_key")
    return hunks.unionByName(_patches_at(places.where(~from_hunk), patches), allowMissingColumns=True)


def records_of_texts(texts: DataFrame) -> DataFrame:
    """The records that are wanted of :func:`texts_at`, cut where the texts are."""
    hunks = texts.where(F.col("source") == FROM_HUNK).drop("source", "positives")
    from_hunks = changed_lines(file_sections(hunks, "text", hunk_mode=True), only="wanted")
    return _hunk_records(from_hunks).unionByName(_cut_patches(texts.where(F.col("source") == FROM_PATCH)))


def _cut_patches(texts: DataFrame) -> DataFrame:
    sections = file_sections(texts.select("pull_request_url", "text", "wanted", "positives"), "text")
    return _patch_records(changed_lines(sections, only="wanted", line_marks={"commented": "positives"}))


def records_at(places: DataFrame, patches: DataFrame, comments: DataFrame) -> DataFrame:
    """The records at some of the :func:`places` of these patches and comments.

    Texts move, and not the records that are cut from them.
    """
    return records_of_texts(texts_at(places, patches, comments))


def patch_records(resolved: DataFrame, compat: bool = False) -> DataFrame:
    """:func:`records_of_patches` of nested rows, however the comments are spread over them."""
    return records_of_patches(newest_patches(resolved), comments_of_rows(resolved), compat)


def distinct_records(resolved: DataFrame, compat: bool = False) -> DataFrame:
    """Structural distinct of the records of nested rows, whatever their origin."""
    patches, comments = newest_patches(resolved), comments_of_rows(resolved)
    found = places(patches, comments, compat, whole=True)
    origin = ["source", "day", "item", "line_at", "text_key"]
    same = [c for c in found.columns if c not in origin]
    first = materialize(found.groupBy(*same).agg(F.min(F.struct(*origin)).alias("origin")).select(*same, "origin.*"))
    return records_at(first, patches, comments).drop("source", "day", "item", "line_at")


def with_commented_lines(records: DataFrame) -> DataFrame:
    """Records of the pull requests that have at least one commented record."""
    commented = records.where("commented").select("pull_request_url").distinct()
    return records.join(commented, "pull_request_url", "left_semi")


def first_per_text(records: DataFrame) -> DataFrame:
    """One record per line text and pull request.

    Commented records with a text come first, then commented ones, then the
    rest; within each in order of origin (source, ``day`` if there is one, item,
    line).  A null comment text counts as a text.
    """
    has_text = F.col("comment_text").isNull() | (F.col("comment_text") != "")
    priority = F.when(F.col("commented") & has_text, 0).when(F.col("commented"), 1).otherwise(2)
    day = ["day"] if "day" in records.columns else []
    # Rows of one origin that the same line of several days has are told apart by what they say.  All columns of
    # places are named here, so that their readers ask for the same ones and share the exchange.
    told_by = ("filename", "comment_text", "is_added", "line", "text_key", "commented")
    ties = [c for c in told_by if c in records.columns]
    window = Window.partitionBy("pull_request_url", "line_text").orderBy(
        priority, "source", *day, "item", "line_at", *ties
    )
    return records.withColumn("nth", F.row_number().over(window)).where("nth = 1").drop("nth")


def records(patches: DataFrame, comments: DataFrame, compat: bool = False) -> DataFrame:
    """Hunk records and patch records together."""
    return records_of_hunks(comments).unionByName(records_of_patches(patches, comments, compat))


def all_records(resolved: DataFrame, compat: bool = False) -> DataFrame:
    """:func:`records` of nested rows."""
    return records(newest_patches(resolved), comments_of_rows(resolved), compat)


def labelled(patches: DataFrame, comments: DataFrame, compat: bool = False) -> DataFrame:
    """Labelled lines of patches (one row per pull request) and their comments, one per line text.

    The structural distinct that precedes the choice per text cannot change its
    result (equal records share their text), so it is not run.  Pull requests
    without any commented record give nothing (``compat`` has no other kind).
    If one has a commented record, one of its chosen records is commented, so
    the chosen ones say which these are.  What moves until then are the places
    of records.  The texts that are cut at last are kept: they are found in the
    job that finds the places, which moves each patch to its pull request once
    for both.
    """
    chosen = first_per_text(places(patches, comments, compat))
    return records_of_texts(
        materialize(texts_at(chosen if compat else with_commented_lines(chosen), patches, comments))
    )


def labelled_lines(resolved: DataFrame, compat: bool = False, newest_by: str | None = None) -> DataFrame:
    """:func:`labelled` of nested rows.

    The comments of a pull request may lie in several rows, of several days or
    parts; of their patches the newest counts.  Pull requests without comments
    are not parsed.
    """
    patches = newest_patches(resolved, newest_by).where("has_comment")
    return labelled(patches, comments_of_rows(resolved, newest_by), compat)
