"""Per-job outcomes and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.functions.findings import truncate_chars
from packsift.operators.running import running_totals
from packsift.settings import MAX_REASON_CHARS

SEPARATOR = "; "


def partial_reasons(
    warnings: DataFrame, job: str, order: Sequence[Column], text: str, limit: int = MAX_REASON_CHARS
) -> DataFrame:
    """Warnings of each job in order, joined by '; ' and cut to ``limit`` characters.

    Only warnings whose separator starts within the first ``limit`` characters can
    show, and each takes at least the separator, so few rows are ever gathered.
    """
    width = F.char_length(text) + len(SEPARATOR)
    placed = running_totals(warnings, [job], order, {"_end": width, "_n": F.lit(1)})
    # The separator before a warning may show although its text does not.
    visible = placed.where(F.col("_end") - width - len(SEPARATOR) < limit)
    gathered = F.array_sort(F.collect_list(F.struct(F.col("_n"), F.col(text).alias("_text"))))
    joined = F.array_join(F.transform(gathered, lambda w: w["_text"]), SEPARATOR)
    return visible.groupBy(job).agg(truncate_chars(joined, limit).alias("partial_reason"))


def first_failures(failures: DataFrame, job: str, seq: str = "seq", limit: int = MAX_REASON_CHARS) -> DataFrame:
    """The reason that ends each failed job: its earliest failure."""
    return failures.groupBy(job).agg(
        truncate_chars(F.min_by("reason", seq), limit).alias("reason")
    )


def job_outcomes(
    jobs: DataFrame, failures: DataFrame, finding_counts: DataFrame, reasons: DataFrame, job: str
) -> DataFrame:
    """One row per job: any failure makes it an error, and then it has no findings.

    All three inputs have one row per job at most, so the joins are even.
    """
    failed = F.col("reason").isNotNull()
    joined = (
        jobs.join(failures, job, "left")
        .join(finding_counts, job, "left")
        .join(reasons, job, "left")
    )
    return joined.withColumns(
        {
            "status": F.when(failed, "error").otherwise("success"),
            "finding_count": F.when(~failed, F.coalesce(F.col("finding_count"), F.lit(0))),
            "partial_reason": F.when(~failed, F.col("partial_reason")),
        }
    )


def job_summary(outcomes: DataFrame) -> DataFrame:
    """Completion counts by status."""
    return outcomes.groupBy("status").agg(
        F.count("*").alias("jobs"),
        F.coalesce(F.sum("finding_count"), F.lit(0)).alias("findings"),
        F.count_if(F.col("partial_reason").isNotNull()).alias("partial_jobs"),
    )


def report_json(success: Sequence[Column], error: Sequence[Column], failed: Column, counters: Column) -> Column:
    """Flat report text: success or error fields, plus the counters as a struct.

    Absent fields are left out by the JSON writer.
    """
    reuse = counters.alias("scan_reuse")
    return F.when(failed, F.to_json(F.struct(*error, reuse))).otherwise(F.to_json(F.struct(*success, reuse)))
