"""One run of a set of jobs with result reuse, from lookups to published reports.

Jobs run in the order of their key: what the first mismatch of a complete job switches off
is off for the jobs after it. Everything is decided on narrow rows; content is scanned in
place, once per identity and run, whatever the number of jobs that hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.operators.dedup import FILE_KEY
from packsift.operators.expand import gather_findings, locate
from packsift.operators.reports import cap_failures, distribution_bases, early_failures, finding_failures, reuse_failures, written_reports
from packsift.operators.reuse import COUNTERS, KEY, counters, decide, decode, evictions, mismatched_keys, storable, with_durable_key
from packsift.operators.running import row_numbers
from packsift.operators.scan import describe, is_scanned, scan
from packsift.operators.skew import skew_safe_join
from packsift.schemas import CACHE_ENTRY, FINDING, NAMESPACE
from packsift.session import settle
from packsift.settings import AUDIT_EVERY, MAX_CACHE_RESULT_BYTES, MAX_DISTRIBUTIONS, MAX_FINDINGS
from packsift.sources.content_store import ContentStore
from packsift.sources.results import ResultTable
from packsift.sources.run_log import PublishedRun, RunLog

#: What two scans of one content must agree in; path and link belong to a file.
CONTENT_FIELDS = [name for name in FINDING.fieldNames() if name not in ("path", "inspector_url")]


@dataclass(frozen=True)
class RunSettings:
    """``namespace`` is (scanner, rules_commit, rules_digest, engine_digest); ``retention``
    bounds the namespace's stored results by number and bytes, first in, first out."""

    namespace: tuple[str, str, str, str]
    mode: str = "reuse"
    audit_every: int = AUDIT_EVERY
    max_findings: int = MAX_FINDINGS
    max_distributions: int = MAX_DISTRIBUTIONS
    retention: tuple[int, int] | None = None


def run_jobs(
    run_id: str,
    jobs: DataFrame,
    manifest: DataFrame,
    store: ContentStore,
    rules: DataFrame,
    archive_failures: DataFrame,
    warnings: DataFrame,
    log: RunLog,
    results: ResultTable,
    settings: RunSettings,
) -> PublishedRun:
    """Publish the tables ``reports``, ``counters``, ``entries`` and ``evicted`` of a run.

    jobs              pkg (the job's key) and the job fields
    manifest          rows of the jobs' files without content, as ``store.add`` returns them
    archive_failures  pkg, dist_index, reason: such a job fails before its files are looked at
    warnings          pkg, seq, text: such a job is incomplete, stores and checks nothing

    Lookups see the stored results and revocations as of the run's start. A run that is
    repeated under its name after it was published adds nothing and returns what it published;
    one that was lost before starts anew.
    """
    done = log.find(run_id)
    if done is None:
        done = log.publish(run_id, *_Run(jobs, manifest, store, rules, archive_failures, warnings, log, results, settings).tables())
    # Also after a loss between the two steps; what is stored already is not stored again.
    results.merge(done.read("entries"), done.read("evicted"))
    return done


@dataclass
class _Run:
    jobs: DataFrame
    manifest: DataFrame
    store: ContentStore
    rules: DataFrame
    archive_failures: DataFrame
    warnings: DataFrame
    log: RunLog
    results: ResultTable
    settings: RunSettings

    def scan(self, wanted: DataFrame) -> DataFrame:
        found = describe(scan(self.store.targets(wanted=wanted), self.rules, ["identity"]), self.rules)
        return settle(found.select("identity", *CONTENT_FIELDS), "findings")

    def facts(self, targets: DataFrame, mode: str) -> DataFrame:
        """Per identity: key, whether a result is stored, its findings where it can be
        decoded, and whether the rules cover such files."""
        identities = targets.select("identity", "sha256", "ext").distinct()
        keyed = with_durable_key(identities).select("identity", *KEY)
        if mode == "off":
            replies = keyed.withColumn("result", F.lit(None).cast("string"))
        else:
            replies = keyed.join(self.results.read(self.settings.namespace).select(*KEY, "result"), KEY, "left")
        joined = identities.join(replies, "identity", "left")
        return settle(
            joined.select("identity", *KEY, F.col("result").isNotNull().alias("stored"), decode(F.col("result")).alias("items"), is_scanned(self.rules).alias("scanned")),
            "facts",
        )

    def measure(self, decisions: DataFrame, old: DataFrame, fresh: DataFrame) -> DataFrame:
        """Decisions with the findings of each target, and whether a check of it failed."""
        checked = decisions.where("candidate AND NOT reused AND scanned").select("identity").distinct()
        wrong = mismatched_keys(
            old.join(checked, "identity", "left_semi"), fresh.join(checked, "identity", "left_semi"), ["identity"], CONTENT_FIELDS
        ).withColumn("differs", F.lit(True))
        n_old, n_new = (rows.groupBy("identity").agg(F.count("*").alias(name)) for rows, name in ((old, "n_old"), (fresh, "n_new")))
        sums = n_old.join(n_new, "identity", "full").join(wrong, "identity", "full")
        joined = skew_safe_join(decisions, sums, ["identity"], "left", spread=["pkg"], weights=decisions)
        n = F.coalesce(F.when(F.col("reused"), F.col("n_old")).otherwise(F.col("n_new")), F.lit(0))
        rows = joined.withColumns({"findings": n * F.col("aliases"), "differs": F.coalesce("differs", F.lit(False))})
        return settle(rows.drop("n_old"), "measured")

    def tables(self) -> tuple[dict[str, DataFrame], list[tuple[str, ...]]]:
        s = self.settings
        mode = "off" if self.log.is_revoked(s.namespace, self.log.version()) else s.mode
        early = settle(early_failures(self.jobs, self.archive_failures, s.max_distributions), "failures")
        runnable = self.jobs.select("pkg").join(early.select("pkg"), "pkg", "left_anti")
        held = self.manifest.groupBy("pkg", "identity", "sha256", "size", "ext").agg(F.count("*").alias("aliases"))
        targets = settle(skew_safe_join(held, runnable, ["pkg"], "left_semi", spread=["identity"], weights=self.manifest), "targets")
        facts = self.facts(targets, mode)
        marks = facts.select("identity", "stored", "scanned", F.when(F.col("items").isNotNull(), F.lit("")).alias("result"))
        looked_up = skew_safe_join(targets.select("pkg", "identity", "size", "aliases"), marks, ["identity"], "left", spread=["pkg"], weights=targets)
        decisions = settle(decide(looked_up, mode, [F.col("pkg"), F.col("identity")], s.audit_every), "decisions")
        old = facts.where("items IS NOT NULL").select("identity", F.inline("items")).select("identity", *CONTENT_FIELDS)

        # Scan what is not reused; the first complete job whose check fails ends reuse.
        fresh = self.scan(decisions.where("NOT reused"))
        measured = self.measure(decisions, old, fresh)
        warned = self.warnings.select("pkg").distinct()
        clean = self.per_job(measured).where("NOT over_limit").join(warned, "pkg", "left_anti")
        stop = clean.where("differs").agg(F.min("pkg")).first()[0]
        if stop is not None:
            on = F.col("pkg") <= F.lit(stop)
            final = decisions.withColumns(
                {"lookups": F.when(on, F.col("lookups")).otherwise(0), **{c: F.col(c) & on for c in ("stored", "candidate", "reused")}}
            )
            decisions = settle(final, "decisions")
            fresh = fresh.unionByName(self.scan(decisions.where("NOT reused").join(fresh_of(measured), "identity", "left_anti")))
            measured = self.measure(decisions, old, fresh)

        # Findings, only for the jobs that do not fail anyway.
        per_job = settle(self.per_job(measured), "jobs")
        invalid = per_job.where((F.col("pkg") == F.lit(stop)) & (F.col("reused") > 0)).select("pkg")
        good = per_job.where("NOT over_limit").join(invalid, "pkg", "left_anti")
        located = self.located(measured, good, old, fresh)
        failures = settle(
            early.unionByName(finding_failures(located)).unionByName(cap_failures(per_job, s.max_findings)).unionByName(reuse_failures(invalid)), "failures"
        )
        complete = good.select("pkg").join(failures.select("pkg"), "pkg", "left_anti").join(warned, "pkg", "left_anti")
        if stop is not None:
            complete = complete.where(F.col("pkg") <= F.lit(stop))
        entries, gone, evicted = self.admission(measured, complete, facts, fresh, mode, stop)

        # A failed job has checked what a complete one would have, unless it failed before.
        checking = clean.select("pkg", F.lit(True).alias("checks"))
        flagged = skew_safe_join(measured, checking, ["pkg"], "left", spread=["identity"], weights=measured)
        flagged = flagged.join(entries.select("pkg", "identity", F.lit(True).alias("inserted")), ["pkg", "identity"], "left")
        validated = F.col("candidate") & ~F.col("reused") & F.col("scanned") & F.coalesce("checks", F.lit(False))
        rows = flagged.withColumns(
            {
                "decode_error": F.col("stored") & F.col("result").isNull(),
                "validated": validated,
                "mismatched": validated & F.col("differs"),
                "inserted": F.coalesce("inserted", F.lit(False)),
            }
        )
        counted = settle(self.jobs.select("pkg").join(counters(rows, evicted), "pkg", "left").fillna(0, COUNTERS), "counters")
        told = counted.select("pkg", F.struct(F.lit(s.namespace[0]).alias("scanner"), F.lit(s.mode).alias("mode"), *COUNTERS).alias("scan_reuse"))
        counts = per_job.select("pkg", F.col("findings").alias("finding_count"))
        reports = written_reports(self.jobs, located, counts, failures, self.warnings, told, s.max_findings)
        tables = {"reports": reports, "counters": counted, "entries": entries, "evicted": gone}
        return tables, [] if stop is None else [s.namespace]

    def per_job(self, measured: DataFrame) -> DataFrame:
        per_job = measured.groupBy("pkg").agg(
            F.sum("findings").alias("findings"),
            F.count_if("reused").alias("reused"),
            F.bool_or(F.col("candidate") & ~F.col("reused") & F.col("scanned") & F.col("differs")).alias("differs"),
        )
        return per_job.withColumn("over_limit", F.col("findings") > self.settings.max_findings)

    def located(self, measured: DataFrame, good: DataFrame, old: DataFrame, fresh: DataFrame) -> DataFrame:
        with_findings = measured.where("findings > 0")
        used = skew_safe_join(with_findings, good.select("pkg"), ["pkg"], "left_semi", spread=["identity"], weights=measured).select("pkg", "identity", "reused")
        items = old.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))
        found = skew_safe_join(used, items, ["identity", "reused"], spread=["pkg"], weights=measured).drop("reused")
        named = skew_safe_join(self.manifest.select(*FILE_KEY, "identity"), found, ["pkg", "identity"], spread=["dist_index", "path"])
        return settle(locate(named.drop("identity"), distribution_bases(self.jobs)), "located")

    def admission(
        self, measured: DataFrame, complete: DataFrame, facts: DataFrame, fresh: DataFrame, mode: str, stop: str | None
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        """New entries with the job that brings each, keys that they push out, and how many
        of these each job causes. The job of the mismatch, and those after it, bring none."""
        s = self.settings
        bringing = complete.where(F.lit(mode != "off"))
        if stop is not None:
            bringing = bringing.where(F.col("pkg") < F.lit(stop))
        pending = measured.where("NOT reused AND scanned AND NOT stored").select("pkg", "identity", "n_new")
        offered = skew_safe_join(pending, bringing, ["pkg"], "left_semi", spread=["identity"], weights=measured)
        # A finding takes more bytes than this, so longer lists cannot be stored.
        short = offered.where(F.coalesce("n_new", F.lit(0)) <= MAX_CACHE_RESULT_BYTES // 64).groupBy("identity").agg(F.min("pkg").alias("pkg"))
        keyed = short.join(facts.where("file_digest IS NOT NULL").select("identity", *KEY), "identity")
        first = settle(keyed.groupBy(*KEY).agg(F.min(F.struct("pkg", "identity")).alias("_f")).select(*KEY, "_f.*"), "first")
        lists = gather_findings(fresh.join(first.select("identity"), "identity", "left_semi"), ["identity"], ["start_line", *[c for c in CONTENT_FIELDS if c != "start_line"]], limit=None)
        blank = lambda item: F.struct(*[(item[n] if n in CONTENT_FIELDS else F.lit("")).alias(n) for n in FINDING.fieldNames()])
        encoded = lists.select("identity", F.to_json(F.transform("items", blank)).alias("result"))
        fitting = storable(first.join(encoded, "identity", "left").withColumn("result", F.coalesce("result", F.lit("[]"))))
        if s.retention is not None:
            fitting = fitting.where(F.octet_length("result") <= s.retention[1])
        stored = self.results.read(s.namespace)
        after = stored.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        numbered = row_numbers(fitting, [], [F.col("pkg"), F.col("file_digest"), F.col("language")], "seq").withColumn("seq", F.col("seq") + after)
        named = numbered.withColumns({n: F.lit(v) for n, v in zip(NAMESPACE, s.namespace, strict=True)})
        entries = settle(named.select(*CACHE_ENTRY.fieldNames(), "seq", "pkg", "identity"), "entries")
        if s.retention is None:
            return entries, entries.select(*NAMESPACE, *KEY).limit(0), entries.select("pkg", F.lit(0).cast("bigint").alias("evicted_files")).limit(0)
        sized = lambda rows, *more: rows.select(*NAMESPACE, *KEY, "seq", F.octet_length("result").cast("bigint").alias("size"), *more)
        per_job, gone = evictions(sized(stored), sized(entries, "pkg"), *s.retention)
        return entries, settle(gone, "evicted"), settle(per_job, "evictions")


def fresh_of(measured: DataFrame) -> DataFrame:
    """Identities that were scanned."""
    return measured.where("NOT reused").select("identity").distinct()
