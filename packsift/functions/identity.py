"""Content identity, target names and cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.functions.paths import extension
from packsift.settings import MAX_LANGUAGE_BYTES


def identity_key(sha256: Column, size: Column, ext: Column) -> Column:
    """One non-null string per (digest, size, extension).

    No extension and an empty one are different identities, so the marker keeps
    them apart; a single string also joins without null-safe comparisons.
    """
    marker = F.when(ext.isNull(), F.lit("none")).otherwise(F.concat(F.lit("ext="), ext))
    return F.concat_ws(":", sha256, size.cast("string"), marker)


def with_identity(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Add sha256, size, ext and identity to files."""
    return files.withColumns(
        {
            "sha256": F.sha2(F.col(content), 256),
            "size": F.octet_length(content).cast("bigint"),
            "ext": extension(F.col(path)),
        }
    ).withColumn("identity", identity_key(F.col("sha256"), F.col("size"), F.col("ext")))


def target_name(target_id: Column, ext: Column) -> Column:
    """16-digit lower-case hex of the id, with the extension if there is one."""
    stem = F.lpad(F.lower(F.hex(target_id)), 16, "0")
    return F.when(F.coalesce(ext, F.lit("")) == "", stem).otherwise(F.concat_ws(".", stem, ext))


def target_id_of(name: Column) -> Column:
    """Inverse of :func:`target_name`."""
    return F.conv(F.substring_index(name, ".", 1), 16, 10).cast("bigint")


def durable_language(ext: Column) -> Column:
    """Language part of the shared key: '' for none; NULL where it is too long to store."""
    language = F.coalesce(ext, F.lit(""))
    return F.when(F.octet_length(language) <= MAX_LANGUAGE_BYTES, language)
