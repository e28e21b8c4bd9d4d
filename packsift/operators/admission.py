"""Archive admission against resource limits.

Entries are rows (archive, name, size, method).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.functions.paths import is_safe_path
from packsift.operators.running import running_totals
from packsift.operators.skew import skew_safe_join
from packsift.settings import ArchiveLimits

SUPPORTED_METHODS = ("stored", "deflated")


def archive_verdicts(entries: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """Per archive: totals and the first limit it breaks, in a fixed rule order."""
    totals = entries.groupBy("archive").agg(
        F.count("*").alias("entries"),
        F.max("size").alias("largest"),
        F.sum("size").alias("expanded"),
        F.bool_and(F.col("method").isin(*SUPPORTED_METHODS)).alias("supported"),
        F.bool_and(is_safe_path(F.col("name"))).alias("contained"),
    )
    verdict = (
        F.when(F.col("entries") > limits.entries, "entries")
        .when(~F.col("supported"), "method")
        .when(F.col("largest") > limits.scan_size, "entry_size")
        .when(F.col("expanded") > limits.expanded_size, "expanded_size")
        .when(~F.col("contained"), "unsafe_path")
        .otherwise("admitted")
    )
    return totals.withColumn("verdict", verdict)


def first_violations(entries: DataFrame, order: list[Column], limits: ArchiveLimits) -> DataFrame:
    """Per archive, the first entry at which reading would stop, and why."""
    running = running_totals(entries, ["archive"], order, {"entry_no": F.lit(1), "running_size": F.col("size")})
    reason = (
        F.when(F.col("entry_no") > limits.entries, "entries")
        .when(F.col("size") > limits.scan_size, "entry_size")
        .when(F.col("running_size") > limits.expanded_size, "expanded_size")
    )
    return (
        running.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .groupBy("archive")
        .agg(F.min(F.struct("entry_no", "size", "running_size", "reason")).alias("_first"))
        .select("archive", "_first.*")
    )


def until_first_timeout(rows: DataFrame, group: list[str], position: str, timed_out: Column) -> DataFrame:
    """Rows before the first one that timed out; later ones are never processed.

    The stop position is a combinable minimum, so no group is sorted in one task.
    """
    stops = rows.where(timed_out).groupBy(*group).agg(F.min(position).alias("_stop"))
    joined = skew_safe_join(rows, stops, group, "left")
    return joined.where(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).drop("_stop")
