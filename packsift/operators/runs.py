"""Reuse of stored results without keeping any; ``job_run`` is the whole run.

Inputs shared by the runs:

store     the content of all files, clustered by identity
index     alias rows with identity, the manifest that ``store.add`` returned
known     identities with a stored result
stored    their stored findings (identity, check_id, start_line, end_line)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.operators.reuse import decide, mismatched_keys
from packsift.operators.scan import scan
from packsift.operators.skew import skew_safe_join
from packsift.session import settle
from packsift.settings import AUDIT_EVERY
from packsift.sources.content_store import ContentStore

_ITEM = ["check_id", "start_line", "end_line"]


def package_targets(index: DataFrame) -> DataFrame:
    return index.groupBy("pkg", "identity", "size").agg(F.count("*").alias("aliases"))


def _with_known(index: DataFrame, known: DataFrame) -> DataFrame:
    marked = known.select("identity", F.lit("stored").alias("result"))
    return skew_safe_join(
        package_targets(index), marked, ["identity"], "left", spread=["pkg"], weights=index
    )


def apply(
    store: ContentStore,
    index: DataFrame,
    rules: DataFrame,
    known: DataFrame,
    stored: DataFrame,
    every: int = AUDIT_EVERY,
) -> tuple[DataFrame, DataFrame]:
    """Reuse stored results except every ``every``-th hit, which is scanned again.

    Jobs run in package order. The first audited mismatch fails its job if that
    job also used stored results, and switches reuse off for the jobs after it.
    Returns ``(findings, jobs)``; a failed job has no findings.
    """
    order = [F.col("pkg"), F.col("identity")]
    decisions = settle(decide(_with_known(index, known), "reuse", order, every), "decisions")
    audited = decisions.where(F.col("candidate") & ~F.col("reused"))
    sampled = audited.select("identity").distinct()
    # What is not reused contains every audited target: one scan serves both.
    pending = decisions.where(~F.col("reused")).select("identity").distinct()
    scanned = settle(scan(store.targets(wanted=pending), rules, ["identity"]), "findings")
    checked = scanned.join(sampled, "identity", "left_semi")
    expected = stored.join(sampled, "identity", "left_semi")
    wrong = mismatched_keys(expected, checked, ["identity"], _ITEM)
    stop = audited.join(wrong, "identity", "left_semi").agg(F.min("pkg")).first()[0]
    trusted = F.col("reused") if stop is None else F.col("reused") & (F.col("pkg") <= F.lit(stop))
    final = decisions.withColumn("reused", trusted)

    jobs = final.groupBy("pkg").agg(
        F.count_if("reused").alias("reused_files"), F.count_if(~F.col("reused")).alias("engine_files")
    )
    failed = F.lit(False) if stop is None else (F.col("pkg") == F.lit(stop)) & (F.col("reused_files") > 0)
    jobs = jobs.withColumn("failed", failed)

    # After a mismatch the later jobs scan what they would have reused.
    more = final.where(~F.col("reused")).select("identity").distinct().join(pending, "identity", "left_anti")
    fresh = scanned
    if stop is not None:
        fresh = scanned.unionByName(scan(store.targets(wanted=more), rules, ["identity"]))
    results = stored.select("identity", *_ITEM, F.lit(True).alias("reused")).unionByName(
        fresh.select("identity", *_ITEM, F.lit(False).alias("reused"))
    )
    used = skew_safe_join(final.select("pkg", "identity", "reused"), results, ["identity", "reused"], spread=["pkg"])
    some_failed = stop is not None and not jobs.where("failed").isEmpty()
    good = used.where(F.col("pkg") != F.lit(stop)) if some_failed else used
    # Findings are few next to aliases: they are expanded only after the filter.
    per_alias = skew_safe_join(
        index.select("pkg", "dist_index", "path", "identity"),
        good.drop("reused"),
        ["pkg", "identity"],
        spread=["dist_index", "path"],
    )
    return per_alias.select("pkg", "dist_index", "path", *_ITEM), jobs
