"""From jobs and their files to one report per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.functions.urls import inspector_base
from packsift.operators.expand import findings_per_group, gather_findings, locate, scan_package
from packsift.operators.outcome import first_failures, job_outcomes, partial_reasons, report_json
from packsift.operators.scan import describe
from packsift.schemas import FINDING
from packsift.session import settle
from packsift.settings import MAX_DISTRIBUTIONS, MAX_FINDINGS
from packsift.sources.jobs import job_distributions, too_many_distributions

# Failures of one job count in the order in which a run meets them.
_TOO_MANY_DISTRIBUTIONS, _ARCHIVE, _FINDING, _CAP, _REUSE = 0, 1, 1_000_000, 1_000_001, 1_000_002


def failure_rows(rows: DataFrame, seq: Column | int, reason: Column) -> DataFrame:
    return rows.select("pkg", (F.lit(seq) if isinstance(seq, int) else seq).cast("bigint").alias("seq"), reason.alias("reason"))


def early_failures(jobs: DataFrame, archive_failures: DataFrame, max_distributions: int = MAX_DISTRIBUTIONS) -> DataFrame:
    """Failures that end a job before any of its files is looked at."""
    too_many = too_many_distributions(F.col("distributions"), max_distributions)
    return failure_rows(jobs.where(too_many.isNotNull()), _TOO_MANY_DISTRIBUTIONS, too_many).unionByName(
        failure_rows(archive_failures, F.col("dist_index") + _ARCHIVE, F.col("reason"))
    )


def finding_failures(located: DataFrame) -> DataFrame:
    return failure_rows(located.where("error IS NOT NULL"), _FINDING, F.col("error"))


def cap_failures(caps: DataFrame, max_findings: int) -> DataFrame:
    return failure_rows(caps.where("over_limit"), _CAP, F.lit(f"too-many-findings: more than {max_findings}"))


def reuse_failures(jobs: DataFrame) -> DataFrame:
    """Jobs that used stored results although a check of them failed."""
    return failure_rows(jobs, _REUSE, F.lit("reuse-invalid: a stored result differs from a fresh scan, those used are discarded"))


def distribution_bases(jobs: DataFrame) -> DataFrame:
    return job_distributions(jobs).select("pkg", "dist_index", inspector_base(F.col("name"), F.col("version"), F.col("url")).alias("base"))


def written_reports(
    jobs: DataFrame,
    located: DataFrame,
    counts: DataFrame,
    failures: DataFrame,
    warnings: DataFrame,
    counters: DataFrame,
    max_findings: int = MAX_FINDINGS,
) -> DataFrame:
    """Rows (pkg, status, finding_count, partial_reason, report); ``counters`` has a struct
    ``scan_reuse`` for each job. Any failure makes the whole job an error without findings."""
    reasons = partial_reasons(warnings, "pkg", [F.col("seq")], "text")
    outcomes = job_outcomes(jobs, first_failures(failures, "pkg"), counts, reasons, "pkg")
    names = FINDING.fieldNames()
    order = ["path", "start_line", "end_line", *[n for n in names if n not in ("path", "start_line", "end_line")]]
    lists = gather_findings(located.where("error IS NULL"), ["pkg"], order, max_findings)
    in_order = F.transform("items", lambda item: F.struct(*[item[name].alias(name) for name in names]))
    none = F.array().cast(f"array<{FINDING.simpleString()}>")
    joined = outcomes.join(lists.select("pkg", in_order.alias("_findings")), "pkg", "left").join(counters.select("pkg", "scan_reuse"), "pkg")
    shared = [F.col(name) for name in ("name", "version", "attempt", "assignment_id")]
    report = report_json(
        success=[*shared, F.col("hash").alias("commit"), F.coalesce("_findings", none).alias("findings"), F.col("partial_reason")],
        error=[*shared, F.col("reason")],
        failed=F.col("status") == "error",
        counters=F.col("scan_reuse"),
    )
    return joined.select("pkg", "status", "finding_count", "partial_reason", report.alias("report"))


def job_reports(
    jobs: DataFrame,
    files: DataFrame,
    rules: DataFrame,
    archive_failures: DataFrame,
    warnings: DataFrame,
    max_findings: int = MAX_FINDINGS,
    max_distributions: int = MAX_DISTRIBUTIONS,
) -> DataFrame:
    """Rows (pkg, status, finding_count, partial_reason, report) of a run without stored
    results; :func:`packsift.operators.job_run.run_jobs` is the run with them.

    jobs              pkg (the job's key) and the job fields
    files             pkg, dist_index, path, content
    archive_failures  pkg, dist_index, reason
    warnings          pkg, seq, text
    """
    found = settle(scan_package(files, rules), "findings")
    located = settle(locate(describe(found, rules), distribution_bases(jobs)), "located")
    caps = findings_per_group(located, ["pkg"], max_findings)
    failures = (
        early_failures(jobs, archive_failures, max_distributions)
        .unionByName(finding_failures(located))
        .unionByName(cap_failures(caps, max_findings))
    )
    counts = caps.select("pkg", F.col("findings").alias("finding_count"))
    off = jobs.select("pkg", F.struct(F.lit("text").alias("scanner"), F.lit("off").alias("mode")).alias("scan_reuse"))
    return written_reports(jobs, located, counts, failures, warnings, off, max_findings)
