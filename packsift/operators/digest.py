"""Digests of small control data: rule corpora and engine binaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.settings import RESULT_FORMAT_TAG


def _joined(pieces: Column) -> Column:
    """Binary value of an array of hexadecimal texts, put together in one pass."""
    return F.unhex(F.array_join(pieces, ""))


def rules_digest(
    rules: DataFrame,
    group: Sequence[str] = (),
    name: str = "name",
    contents: str = "contents",
) -> DataFrame:
    """SHA-256 over name-sorted (name, contents), each after its 8-byte length.

    The hash runs over its input in order, so the rules of one group meet in one task.
    """

    def framed(value: Column) -> Column:
        return F.concat(F.lpad(F.hex(F.octet_length(value)), 16, "0"), F.hex(F.encode(value, "UTF-8")))

    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(contents).alias("c"))))
    return rules.groupBy(*group).agg(pairs.alias("_pairs")).select(
        *group,
        F.sha2(_joined(F.transform("_pairs", lambda p: F.concat(framed(p["n"]), framed(p["c"])))), 256).alias("digest"),
    )


def engine_digest(
    blobs: DataFrame,
    order: str,
    content: str = "content",
    tag: str = RESULT_FORMAT_TAG,
) -> DataFrame:
    """SHA-256 over the blobs' binary digests in order, then a format tag.

    Blobs are hashed where they are; 64 characters of each meet in one task.
    """
    hashed = blobs.select(F.col(order).alias("o"), F.sha2(content, 256).alias("d"))
    parts = hashed.agg(F.array_sort(F.collect_list(F.struct("o", "d"))).alias("_parts"))
    digests = F.transform("_parts", lambda p: p["d"])
    return parts.select(F.sha2(F.concat(_joined(digests), F.encode(F.lit(tag), "UTF-8")), 256).alias("digest"))
