"""Aggregations: identities, admission, digests, outcomes and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.functions.paths import basename
from packsift.operators.admission import archive_verdicts
from packsift.operators.dedup import (
    corpus_identities,
    file_index,
    package_counts,
    package_identities,
)
from packsift.operators.digest import engine_digest, rules_digest
from packsift.operators.expand import findings_per_group, gather_findings
from packsift.operators.outcome import (
    first_failures,
    job_outcomes,
    job_summary,
    partial_reasons,
)
from packsift.operators.reuse import mismatched_keys
from packsift.operators.scan import rules_reusable
from packsift.plans.catalog import query
from packsift.plans.corpus import Corpus
from packsift.plans.joins import STORED
from packsift.plans.views import ENTRIES, FINDINGS, INDEX, entries, files, table, warnings
from packsift.settings import ArchiveLimits

TEST_LIMITS = ArchiveLimits(entries=6, scan_size=100_000, expanded_size=400_000)


@query(
    "agg_distinct_identity",
    f"WITH {INDEX} SELECT pkg, sha256, size, ext, count(*) AS aliases FROM index GROUP BY ALL",
)
def agg_distinct_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package_identities(file_index(files(spark, sf_dir)))


@query(
    "agg_dedup_counts",
    f"""WITH {INDEX} SELECT pkg, count(*) AS aliases, count(DISTINCT identity) AS unique_targets,
  count(*) - count(DISTINCT identity) AS deduplicated FROM index GROUP BY pkg""",
)
def agg_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package_counts(file_index(files(spark, sf_dir)))


@query(
    "agg_corpus_dedup",
    f"""WITH {INDEX} SELECT sha256, size, ext, count(*) AS files, count(DISTINCT pkg) AS packages,
  CAST(sum(size) AS BIGINT) AS bytes FROM index GROUP BY sha256, size, ext""",
)
def agg_corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_identities(file_index(files(spark, sf_dir)))


@query(
    "agg_archive_admission",
    f"""WITH {ENTRIES}, t AS (
  SELECT archive, count(*) AS entries, max(size) AS largest, CAST(sum(size) AS BIGINT) AS expanded,
    bool_and(method IN ('stored', 'deflated')) AS supported, bool_and(name NOT LIKE '../%') AS contained
  FROM entries GROUP BY archive)
SELECT *, CASE WHEN entries > 6 THEN 'entries' WHEN NOT supported THEN 'method' WHEN largest > 100000 THEN 'entry_size'
  WHEN expanded > 400000 THEN 'expanded_size' WHEN NOT contained THEN 'unsafe_path' ELSE 'admitted' END AS verdict FROM t""",
)
def agg_archive_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_verdicts(entries(spark, sf_dir), TEST_LIMITS)


@query(
    "agg_findings_by_target",
    f"""WITH {FINDINGS} SELECT identity, CAST(count(*) AS INTEGER) AS findings,
  string_agg(check_id || '@' || start_line, ',' ORDER BY check_id, start_line) AS items FROM findings GROUP BY identity""",
)
def agg_findings_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = gather_findings(Corpus(spark, sf_dir).findings, ["identity"], ["check_id", "start_line"], limit=None)
    label = F.transform("items", lambda i: F.concat(i["check_id"], F.lit("@"), i["start_line"].cast("string")))
    return lists.select("identity", F.size("items").alias("findings"), F.array_join(label, ",").alias("items"))


@query(
    "agg_findings_cap",
    f"""WITH {FINDINGS} SELECT pkg, count(*) AS findings, count(*) > 4 AS over_limit
FROM index JOIN findings USING (identity) GROUP BY pkg""",
)
def agg_findings_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings_per_group(Corpus(spark, sf_dir).expanded, ["pkg"], limit=4)


@query(
    "agg_partial_reason",
    """SELECT conv_id AS job, substr(string_agg(text, '; ' ORDER BY turn), 1, 2048) AS partial_reason
FROM conversations GROUP BY conv_id""",
)
def agg_partial_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_reasons(warnings(spark, sf_dir), "job", [F.col("seq")], "warning")


@query(
    "agg_rules_reusable",
    """WITH r AS (SELECT conv_id AS snapshot, turn <> 7 AND role <> 'system' AND NOT contains(text, 'ß') AS plain FROM conversations)
SELECT snapshot, count(*) AS rules, count_if(plain) AS plain_rules, bool_and(plain) AS reusable FROM r GROUP BY snapshot""",
)
def agg_rules_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as snapshots, turns as rules."""
    properties = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("snapshot"),
        F.when(F.col("turn") == 7, "src/**").alias("paths"),
        F.when(F.contains(F.col("text"), F.lit("ß")), "interfile").alias("options"),
        F.lit(None).cast("string").alias("dependency_formula"),
        F.lit(None).cast("string").alias("validators"),
        F.lit("SAST").alias("product"),
        F.when(F.col("role") == "system", "extract")
        .when(F.col("role") == "user", "search")
        .otherwise("taint")
        .alias("mode"),
    )
    return rules_reusable(properties, ["snapshot"])


@query(
    "agg_rules_digest",
    """WITH r AS (SELECT conv_id, 'rules/' || lpad(CAST(turn AS VARCHAR), 4, '0') || '.yml' AS name, text FROM conversations)
SELECT conv_id, sha256(unhex(string_agg(
  lpad(to_hex(strlen(name)), 16, '0') || hex(encode(name)) || lpad(to_hex(strlen(text)), 16, '0') || hex(encode(text)), '' ORDER BY name))) AS digest
FROM r GROUP BY conv_id""",
)
def agg_rules_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.concat(F.lit("rules/"), F.lpad(F.col("turn").cast("string"), 4, "0"), F.lit(".yml")).alias("name"),
        F.col("text").alias("contents"),
    )
    return rules_digest(named, ["conv_id"])


@query(
    "agg_engine_digest",
    """SELECT sha256(unhex(string_agg(sha256(text), '' ORDER BY item_id) || hex(encode('durable-file-results-v1')))) AS digest
FROM benchmark""",
)
def agg_engine_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_digest(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(
    "agg_findings_multiset_eq",
    f"""WITH {STORED}
SELECT identity, NOT (poisoned = 1 AND identity IN (SELECT identity FROM findings)) AS equal FROM known""",
)
def agg_findings_multiset_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = Corpus(spark, sf_dir)
    differing = mismatched_keys(
        corpus.stored, corpus.fresh_of_known, ["identity"], ["check_id", "start_line", "end_line"]
    ).withColumn("equal", F.lit(False))
    return corpus.known.join(differing, "identity", "left").select("identity", F.coalesce("equal", F.lit(True)).alias("equal"))


# -- outcomes ------------------------------------------------------------------------


def _failures(corpus: Corpus, limit: int = 26_000) -> DataFrame:
    """Packages with a file over the limit; the first such file names the reason."""
    size = F.col("size")
    reason = F.concat(
        F.lit("entry "), F.col("path"), F.lit(" is "), size.cast("string"), F.lit(f" bytes, exceeding the {limit}-byte scan limit")
    )
    rows = corpus.index.where(size > limit)
    return rows.select("pkg", F.col("doc_id").alias("seq"), reason.alias("reason"))


def _warnings(corpus: Corpus) -> DataFrame:
    """Spanish scripts count as partially parsed."""
    rows = corpus.index.where((F.col("dist_index") == 2) & F.col("path").endswith(".js"))
    return rows.select(
        "pkg", F.col("doc_id").alias("seq"), F.concat(F.lit("partly-parsed: "), basename(F.col("path"))).alias("warning")
    )


def outcomes(corpus: Corpus) -> DataFrame:
    jobs = corpus.index.select("pkg").distinct()
    counts = corpus.expanded.groupBy("pkg").agg(F.count("*").alias("finding_count"))
    reasons = partial_reasons(_warnings(corpus), "pkg", [F.col("seq")], "warning")
    return job_outcomes(jobs, first_failures(_failures(corpus), "pkg"), counts, reasons, "pkg")


OUTCOMES = f"""{FINDINGS},
failures AS (
  SELECT pkg, min_by('entry ' || path || ' is ' || strlen(content) || ' bytes, exceeding the 26000-byte scan limit', doc_id) AS reason
  FROM index WHERE strlen(content) > 26000 GROUP BY pkg),
counts AS (SELECT pkg, count(*) AS n FROM index JOIN findings USING (identity) GROUP BY pkg),
partials AS (
  SELECT pkg, substr(string_agg('partly-parsed: ' || string_split(path, '/')[-1], '; ' ORDER BY doc_id), 1, 2048) AS text
  FROM index WHERE dist_index = 2 AND path LIKE '%.js' GROUP BY pkg),
outcomes AS (
  SELECT pkg, CASE WHEN reason IS NULL THEN 'success' ELSE 'error' END AS status, reason,
    CASE WHEN reason IS NULL THEN coalesce(n, 0) END AS finding_count, CASE WHEN reason IS NULL THEN text END AS partial_reason
  FROM (SELECT DISTINCT pkg FROM index) LEFT JOIN failures USING (pkg) LEFT JOIN counts USING (pkg) LEFT JOIN partials USING (pkg))"""


@query("agg_job_outcome", f"WITH {OUTCOMES} SELECT pkg, status, reason, finding_count, partial_reason FROM outcomes")
def agg_job_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(Corpus(spark, sf_dir)).select("pkg", "status", "reason", "finding_count", "partial_reason")


@query(
    "agg_job_summary",
    f"""WITH {OUTCOMES} SELECT status, count(*) AS jobs, CAST(coalesce(sum(finding_count), 0) AS BIGINT) AS findings,
  count_if(partial_reason IS NOT NULL) AS partial_jobs FROM outcomes GROUP BY status""",
)
def agg_job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_summary(outcomes(Corpus(spark, sf_dir)))
