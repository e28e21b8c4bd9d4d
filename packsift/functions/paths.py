"""Archive and finding paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsift.functions.binding import let
from packsift.settings import MAX_PATH_BYTES


def is_safe_path(path: Column) -> Column:
    """Non-empty and made of ordinary relative components only.

    ``a//b`` and ``a/./b`` are accepted: a path parser collapses them.
    """
    return (
        (path != "")
        & ~path.startswith("/")
        & ~(path.contains("..") & path.rlike(r"(^|/)\.\.(/|\z)"))
        & ~path.rlike(r"^\.(/|\z)")
    )


def relative_path(path: Column, root: Column) -> Column:
    """Struct ``(path, error)``: ``path`` below ``root``, with forward slashes.

    Safety is checked before *and* after backslashes become slashes, so a
    ``..\\x`` that turns into a parent step is rejected too.
    """
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    below = F.regexp_replace(
        F.substring(path, F.char_length(prefix) + 1, F.char_length(path)), r"^(?:\.?/)+", ""
    )
    stripped = F.when(~path.startswith("/"), path).when(path.startswith(prefix), below)

    def checked(names: Column) -> Column:
        error = (
            F.when(names["raw"].isNull(), F.lit("path-elsewhere: not below the target"))
            .when(names["raw"] == "", F.lit("path-empty: nothing left below the target"))
            .when(
                ~is_safe_path(names["raw"]) | ~is_safe_path(names["slashed"]),
                F.lit("path-not-plain: a step leaves or repeats a folder"),
            )
            .when(F.octet_length(names["slashed"]) > MAX_PATH_BYTES, F.lit(f"path-too-long: more than {MAX_PATH_BYTES} bytes"))
        )
        return let(
            error,
            lambda e: F.struct(F.when(e.isNull(), names["slashed"]).alias("path"), e.alias("error")),
        )

    both = lambda raw: F.struct(raw.alias("raw"), F.replace(raw, F.lit("\\"), F.lit("/")).alias("slashed"))
    return let(let(stripped, both), checked)


def basename(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the file name; NULL for ``.bashrc``, '' for ``foo.``."""
    base = basename(path)
    return F.when(
        base.rlike(r"(?s)^.+\.[^.]*\z") & (base != ".."), F.substring_index(base, ".", -1)
    )


def path_parts(path: Column) -> Column:
    """Sort key that compares component by component, so ``a/b`` < ``a.b``."""
    return F.split(path, "/")
