"""Reduce files to distinct content identities and keep their aliases.

Files are rows (pkg, dist_index, path, content) with a unique
(pkg, dist_index, path). Content is hashed once, then only narrow rows are
shuffled; content itself is joined back for one representative per identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.functions.identity import with_identity
from packsift.functions.paths import path_parts
from packsift.operators.running import row_numbers, running_totals
from packsift.operators.skew import skew_safe_join
from packsift.session import settle, spread
from packsift.settings import MAX_SCAN_SIZE

FILE_KEY = ["pkg", "dist_index", "path"]
IDENTITY = ["sha256", "size", "ext"]


def within_scan_size(files: DataFrame, limit: int = MAX_SCAN_SIZE) -> DataFrame:
    """Silently leave out files larger than the limit, before any hashing."""
    return files.where(F.octet_length("content") <= limit)


def file_index(files: DataFrame) -> DataFrame:
    """Narrow alias rows: file key, identity and whatever else but content."""
    return with_identity(files).drop("content")


def write_manifest(index: DataFrame) -> DataFrame:
    """Store alias rows and read them back, so content is hashed only once."""
    return settle(index, "manifest")


def package_identities(index: DataFrame) -> DataFrame:
    """Distinct identities of each package, with the number of aliases."""
    return index.groupBy("pkg", *IDENTITY).agg(F.count("*").alias("aliases"))


def package_counts(index: DataFrame) -> DataFrame:
    """Per package: aliases, unique targets and files saved by deduplication."""
    return (
        package_identities(index)
        .groupBy("pkg")
        .agg(F.sum("aliases").alias("aliases"), F.count("*").alias("unique_targets"))
        .withColumn("deduplicated", F.col("aliases") - F.col("unique_targets"))
    )


def corpus_identities(index: DataFrame) -> DataFrame:
    """Per identity over all packages: files, packages and bytes held."""
    # Two combining steps, so a copy found in every package stays cheap.
    return (
        package_identities(index)
        .groupBy(*IDENTITY)
        .agg(
            F.sum("aliases").alias("files"),
            F.count("*").alias("packages"),
            F.sum(F.col("aliases") * F.col("size")).alias("bytes"),
        )
    )


def representatives(index: DataFrame) -> DataFrame:
    """One file key per identity over the whole corpus."""
    return (
        index.groupBy("identity")
        .agg(F.min(F.struct(*FILE_KEY, *IDENTITY)).alias("_rep"))
        .select("identity", "_rep.*")
    )


def distinct_targets(
    files: DataFrame, index: DataFrame, wanted: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """One row with content per identity, of the ``wanted`` and not ``known`` ones.

    Identities are chosen on narrow rows, before content is read. The file key is
    unique, so the join is even; on a files table bucketed by the key, content is
    not shuffled. Should a key repeat after all, only content of the chosen identity
    passes.
    """
    chosen = representatives(index)
    if wanted is not None:
        chosen = chosen.join(wanted.select("identity"), "identity", "left_semi")
    if known is not None:
        chosen = chosen.join(known.select("identity"), "identity", "left_anti")
    content = spread(files.select(*FILE_KEY, "content"), *FILE_KEY)
    same = F.sha2(F.col("content").cast("binary"), 256) == F.col("sha256")
    return content.join(chosen, FILE_KEY).where(same).select("identity", *IDENTITY, "content", *FILE_KEY)


def alias_order() -> list[Column]:
    return [F.col("dist_index"), path_parts(F.col("path"))]


def target_ids(index: DataFrame) -> DataFrame:
    """Add a dense 0-based target_id per package in first-seen order."""
    firsts = (
        index.withColumn("_parts", path_parts(F.col("path")))
        .groupBy("pkg", "identity")
        .agg(F.min(F.struct("dist_index", "_parts")).alias("_first"))
    )
    numbered = row_numbers(
        firsts, ["pkg"], [F.col("_first.dist_index"), F.col("_first._parts")], "_n"
    ).select("pkg", "identity", (F.col("_n") - 1).alias("target_id"))
    return skew_safe_join(index, numbered, ["pkg", "identity"], spread=FILE_KEY)


def bounded_groups(
    rows: DataFrame, group: list[str], order: list[Column], size: int, name: str = "group_no"
) -> DataFrame:
    """Split each group into runs of at most ``size`` rows, numbered from 0."""
    numbered = row_numbers(rows, group, order, "_n")
    return numbered.withColumn(name, F.floor((F.col("_n") - 1) / size).cast("bigint")).drop("_n")


def ordered_paths(files: DataFrame, name: str = "position") -> DataFrame:
    """Number all files in component-wise path order."""
    return running_totals(files, [], [path_parts(F.col("path"))], {name: F.lit(1)})
