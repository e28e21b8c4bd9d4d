"""Map findings on distinct targets back to every original path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packsift.functions.paths import extension
from packsift.functions.urls import inspector_url
from packsift.operators.dedup import FILE_KEY, within_scan_size
from packsift.operators.scan import rules_reusable, scan
from packsift.operators.skew import skew_safe_join
from packsift.session import spread
from packsift.settings import MAX_FINDINGS, MAX_PATH_BYTES, MAX_SCAN_SIZE
from packsift.sources.content_store import ContentStore, stored_files


def expand_findings(aliases: DataFrame, findings: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row per (alias, finding); aliases without findings are dropped.

    Many packages hold the same file, so one identity can own a large share of
    the aliases: the join is salted. ``aliases`` is best a stored manifest.
    """
    return skew_safe_join(aliases, findings, ["identity"], spread=FILE_KEY, weights=weights)


def locate(expanded: DataFrame, distributions: DataFrame) -> DataFrame:
    """Add the inspector location. ``distributions`` is (pkg, dist_index, base).

    A finding whose distribution is unknown, or whose location is too long, gets
    an ``error`` instead. ``expanded`` is best a stored table.
    """
    joined = skew_safe_join(expanded, distributions, ["pkg", "dist_index"], "left")
    link = inspector_url(F.col("base"), F.col("path"))
    error = F.coalesce(
        F.when(F.col("base").isNull(), F.lit("no-distribution: the finding's archive is not among the job's")),
        F.when(F.octet_length("path") > MAX_PATH_BYTES, F.lit(f"path-too-long: more than {MAX_PATH_BYTES} bytes")),
        link["error"],
    )
    return joined.select(
        *expanded.columns, F.when(error.isNull(), link["url"]).alias("inspector_url"), error.alias("error")
    )


def findings_per_group(findings: DataFrame, group: list[str], limit: int = MAX_FINDINGS) -> DataFrame:
    """Findings per group and whether they exceed the cap, which is an error."""
    return findings.groupBy(*group).agg(
        F.count("*").alias("findings"), (F.count("*") > limit).alias("over_limit")
    )


def gather_findings(
    findings: DataFrame, group: list[str], order: list[str], limit: int | None = MAX_FINDINGS
) -> DataFrame:
    """Ordered finding lists per group; NULL where the cap is exceeded.

    Ranks are cut at the cap before rows are gathered (Spark applies that cut
    ahead of the shuffle), so a list never holds more than ``limit`` items. Without
    a limit every list is whole: for groups that are one file, whose lines bound it.
    """
    if limit is None:
        items = F.array_sort(F.collect_list(F.struct(*order))).alias("items")
        return findings.groupBy(*group).agg(items).withColumn("over_limit", F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    kept = findings.withColumn("_rank", rank).where(F.col("_rank") <= limit + 1)
    item = F.struct(*order)
    lists = kept.groupBy(*group).agg(
        F.max("_rank").alias("_rows"), F.array_sort(F.collect_list(item)).alias("items")
    )
    over = F.col("_rows") > limit
    return lists.select(
        *group, F.when(~over, F.col("items")).alias("items"), over.alias("over_limit")
    )


def scan_package(files: DataFrame, rules: DataFrame, max_size: int = MAX_SCAN_SIZE) -> DataFrame:
    """Deduplicate, scan each identity once, expand to every path.

    Content-only rules give equal results for equal identities in any package,
    so identities are distinct over the whole corpus, not only per package. The files
    are stored by content first; with a store at hand, ``scan_stored`` is the rest.
    """
    store, manifest = stored_files(within_scan_size(files, max_size))
    return scan_stored(store, manifest, rules)


def scan_stored(store: ContentStore, manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of the files of ``manifest``, whose content is in ``store`` and stays there."""
    findings = scan(store.targets(wanted=manifest), rules, ["identity"])
    return expand_findings(manifest, findings).select(*FILE_KEY, "check_id", "start_line", "end_line")


def scan_by_distribution(files: DataFrame, rules: DataFrame, max_size: int = MAX_SCAN_SIZE) -> DataFrame:
    """Scan every file at its own path, for rules that look at paths."""
    targets = spread(within_scan_size(files, max_size), *FILE_KEY).withColumn("ext", extension(F.col("path")))
    return scan(targets, rules, FILE_KEY).select(*FILE_KEY, "check_id", "start_line", "end_line")


def scan_corpus(files: DataFrame, rules: DataFrame, rule_properties: DataFrame) -> DataFrame:
    """Deduplicated scan when all rules allow content reuse, else file by file."""
    reusable = rules_reusable(rule_properties).first()["reusable"]
    return scan_package(files, rules) if reusable else scan_by_distribution(files, rules)
