"""Runs of jobs with stored results, whole: reports, counters, revocation.

The packages are the jobs. What labelled files were found to hold in an earlier run is stored;
some of it is stored as clean although it is not, some cannot be decoded. Packages named …7
come with warnings, an archive of those named …13 cannot be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.functions.identity import durable_language
from packsift.functions.paths import basename
from packsift.operators.expand import gather_findings
from packsift.operators.job_run import CONTENT_FIELDS, RunSettings, run_jobs
from packsift.operators.reuse import COUNTERS
from packsift.operators.running import row_numbers
from packsift.operators.scan import describe, scan
from packsift.plans.catalog import query
from packsift.plans.corpus import Corpus
from packsift.plans.views import CACHED, EVIDENCE, INDEX, RULES, rules
from packsift.schemas import CACHE_ENTRY, FINDING, NAMESPACE
from packsift.session import output_dir, settle
from packsift.sources.results import ResultTable
from packsift.sources.run_log import PublishedRun, RunLog

SPACE = ("text", "rules-new", "rules-1", "engine-1")
CAP = 6
COVERED = ["python", "javascript"]


def covering_rules(spark: SparkSession) -> DataFrame:
    """All rules, each for both languages."""
    return rules(spark).withColumn("languages", F.array(*map(F.lit, COVERED)))


def earlier_results(corpus: Corpus, corpus_rules: DataFrame) -> DataFrame:
    """Stored results of the labelled files that the rules cover."""
    covered = corpus.cached.where(F.col("ext").isin("py", "js"))
    per = covered.groupBy("identity", "sha256", "ext").agg(
        (F.min("quality") == 0).alias("broken"), ((F.max("toxic") == 1) | (F.min("doc_id") % 5 == 0)).alias("poisoned")
    )
    # Kept: numbering reads its rows twice, which would scan the content twice.
    found = settle(describe(scan(corpus.store.targets(wanted=per), corpus_rules, ["identity"]), corpus_rules), "earlier-findings")
    lists = gather_findings(found, ["identity"], ["start_line", *[c for c in CONTENT_FIELDS if c != "start_line"]], limit=None)
    blank = lambda item: F.struct(*[(item[n] if n in CONTENT_FIELDS else F.lit("")).alias(n) for n in FINDING.fieldNames()])
    text = F.when(F.col("broken"), "[{").when(F.col("poisoned"), "[]").otherwise(F.coalesce(F.to_json(F.transform("items", blank)), F.lit("[]")))
    rows = per.join(lists, "identity", "left").select(
        *[F.lit(v).alias(n) for n, v in zip(NAMESPACE, SPACE, strict=True)],
        F.col("sha256").alias("file_digest"),
        durable_language(F.col("ext")).alias("language"),
        text.alias("result"),
    )
    return row_numbers(rows, [], [F.col("file_digest"), F.col("language")], "seq").select(*CACHE_ENTRY.fieldNames(), "seq")


class Jobs:
    """Jobs, their files and an earlier run's results."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.corpus = Corpus(spark, sf_dir)
        self.rules = covering_rules(spark)
        index = self.corpus.index
        held = index.groupBy("pkg").agg(F.count_distinct("dist_index").alias("n"))
        urls = [F.lit(f"https://files.example.org/dist-{i}.whl") for i in range(4)]
        self.jobs = settle(
            held.select(
                "pkg",
                F.lit("rules-new").alias("hash"),
                F.col("pkg").alias("name"),
                F.lit("1.0").alias("version"),
                F.array(*urls).alias("distributions"),
                (F.col("n") + 1).alias("attempt"),
                F.concat(F.lit("lease-"), F.col("pkg")).alias("assignment_id"),
            ),
            "jobs",
        )
        self.failures = index.where("pkg LIKE '%13'").select("pkg", "dist_index", F.concat(F.lit("unreadable: archive "), F.col("dist_index").cast("string")).alias("reason")).distinct()
        self.warnings = index.where("pkg LIKE '%7' AND size > 2000").select(
            "pkg", F.col("doc_id").alias("seq"), F.concat(F.lit("partly-parsed: "), basename(F.col("path"))).alias("text")
        )
        self.log = RunLog(spark, output_dir(spark, "runs"))
        self.results = ResultTable(spark, output_dir(spark, "results"))
        self.results.merge(earlier_results(self.corpus, self.rules))

    def run(self, run_id: str, mode: str, **settings) -> PublishedRun:
        return run_jobs(
            run_id,
            self.jobs,
            self.corpus.index,
            self.corpus.store,
            self.rules,
            self.failures,
            self.warnings,
            self.log,
            self.results,
            RunSettings(SPACE, mode, max_findings=CAP, **settings),
        )


def run_sql(mode: str, every: int, retention: tuple[int, int] | None = None) -> str:
    """Decisions ``x`` per target, ``st`` per job, counters ``c`` of the run."""
    reused = f"coalesce(candidate AND hit_no % {every} <> 0, FALSE)" if mode == "reuse" else "FALSE"
    entries, size = retention or (1 << 40, 1 << 40)
    evidence = ",".join(f'"{name}":"{value}"' for name, value in EVIDENCE.items())
    return f"""{INDEX}, {RULES}, {CACHED}, targets AS (
  SELECT identity, any_value(sha256) AS sha256, any_value(ext) AS ext, any_value(content) AS content FROM index GROUP BY identity),
lines AS (
  SELECT identity, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS start_line
  FROM targets WHERE ext IN ('py', 'js')),
f AS (SELECT identity, string_split(check_id, '.')[-1] AS rule_id, message, severity, start_line FROM lines JOIN rules ON regexp_matches(line, pattern)),
nf AS (SELECT identity, count(*) AS n, '[' || string_agg('{{"rule_id":"' || rule_id || '","path":"","start_line":' || start_line || ',"end_line":' || start_line
  || ',"message":"' || message || '","severity":"' || severity || '",{evidence},"inspector_url":""}}', ',') || ']' AS text FROM f GROUP BY identity),
seed AS (
  SELECT identity, sha256, ext, min(quality) = 0 AS broken, max(toxic) = 1 OR min(doc_id) % 5 = 0 AS poisoned
  FROM cached WHERE ext IN ('py', 'js') GROUP BY identity, sha256, ext),
bad AS (SELECT pkg, min_by('unreadable: archive ' || dist_index, dist_index) AS reason FROM index WHERE pkg LIKE '%13' GROUP BY pkg),
warned AS (
  SELECT pkg, substr(string_agg('partly-parsed: ' || string_split(path, '/')[-1], '; ' ORDER BY doc_id), 1, 2048) AS partial_reason
  FROM index WHERE pkg LIKE '%7' AND size > 2000 GROUP BY pkg),
t AS (SELECT pkg, identity, sha256, size, ext, count(*) AS aliases FROM index WHERE pkg NOT IN (SELECT pkg FROM bad) GROUP BY ALL),
l AS (SELECT t.*, s.identity IS NOT NULL AS stored, coalesce(broken, FALSE) AS broken, s.identity IS NOT NULL AND NOT broken AS candidate,
    coalesce(poisoned, FALSE) AS poisoned, coalesce(n, 0) AS n_new, CASE WHEN NOT broken AND NOT poisoned THEN coalesce(n, 0) ELSE 0 END AS n_old
  FROM t LEFT JOIN seed s USING (identity) LEFT JOIN nf USING (identity)),
h AS (SELECT *, CASE WHEN candidate THEN row_number() OVER (PARTITION BY candidate ORDER BY pkg, identity) END AS hit_no FROM l),
d AS (SELECT *, {reused} AS first_reused, poisoned AND n_new > 0 AS differs FROM h),
clean AS (
  SELECT pkg, bool_or(candidate AND NOT first_reused AND differs) AS differs FROM d WHERE pkg NOT IN (SELECT pkg FROM warned)
  GROUP BY pkg HAVING sum(aliases * CASE WHEN first_reused THEN n_old ELSE n_new END) <= {CAP}),
s AS (SELECT min(pkg) AS stop FROM clean WHERE differs),
x AS (
  SELECT d.* EXCLUDE (stored, candidate), stop, CASE WHEN stop IS NULL OR pkg <= stop THEN 1 ELSE 0 END AS lookups, stored AND lookups = 1 AS stored,
    candidate AND lookups = 1 AS candidate, first_reused AND lookups = 1 AS reused FROM d, s),
j AS (SELECT pkg, CAST(sum(aliases * CASE WHEN reused THEN n_old ELSE n_new END) AS BIGINT) AS findings, count_if(reused) AS n_reused, any_value(stop) AS stop
  FROM x GROUP BY pkg),
st AS (
  SELECT p.pkg, coalesce(findings, 0) AS findings, attempt, partial_reason, stop, coalesce(bad.reason,
    CASE WHEN findings > {CAP} THEN 'too-many-findings: more than {CAP}'
      WHEN p.pkg = stop AND n_reused > 0 THEN 'reuse-invalid: a stored result differs from a fresh scan, those used are discarded' END) AS reason
  FROM (SELECT pkg, count(DISTINCT dist_index) + 1 AS attempt FROM index GROUP BY pkg) p
  LEFT JOIN j USING (pkg) LEFT JOIN bad USING (pkg) LEFT JOIN warned USING (pkg)),
offered AS (
  SELECT identity, sha256, ext, min(pkg) AS pkg FROM x WHERE NOT reused AND NOT stored AND ext IN ('py', 'js')
    AND pkg IN (SELECT pkg FROM st WHERE reason IS NULL AND partial_reason IS NULL AND (stop IS NULL OR pkg < stop)) GROUP BY ALL),
ins AS (
  SELECT *, row_number() OVER (ORDER BY pkg, sha256, ext) + (SELECT count(*) FROM seed) AS seq FROM (
    SELECT pkg, identity, sha256, ext, strlen(coalesce(text, '[]')) AS bytes FROM offered LEFT JOIN nf USING (identity)) WHERE bytes <= least(16384, {size})),
fifo AS (
  SELECT *, row_number() OVER (ORDER BY seq) AS n, sum(bytes) OVER (ORDER BY seq) AS b FROM (
    SELECT NULL AS pkg, row_number() OVER (ORDER BY sha256, ext) AS seq, strlen(CASE WHEN broken THEN '[{{' WHEN poisoned THEN '[]' ELSE coalesce(text, '[]') END) AS bytes
    FROM seed LEFT JOIN nf USING (identity) UNION ALL SELECT pkg, seq, bytes FROM ins)),
ends AS (SELECT pkg, max(n) AS n, max(b) AS b FROM fifo WHERE pkg IS NOT NULL GROUP BY pkg),
gone AS (SELECT pkg, n, greatest(n - {entries}, (SELECT count(*) FROM fifo WHERE fifo.b - fifo.bytes < ends.b - {size}), 0) AS total FROM ends),
ev AS (SELECT pkg, CAST(total - coalesce(lag(total) OVER (ORDER BY n), 0) AS BIGINT) AS evicted_files FROM gone),
counted AS (
  SELECT pkg, CAST(sum(lookups) AS BIGINT) AS lookups, count_if(candidate) AS candidate_files, count_if(reused) AS reused_files,
    CAST(coalesce(sum(size) FILTER (reused), 0) AS BIGINT) AS reused_bytes, count_if(ins.identity IS NOT NULL) AS inserted_files,
    count_if(stored AND broken) AS errors, count_if(candidate AND NOT reused AND clean.pkg IS NOT NULL) AS validated_files,
    count_if(candidate AND NOT reused AND clean.pkg IS NOT NULL AND x.differs) AS mismatched_files, count_if(NOT reused) AS engine_files,
    CAST(coalesce(sum(size) FILTER (NOT reused), 0) AS BIGINT) AS engine_bytes
  FROM x LEFT JOIN ins USING (pkg, identity) LEFT JOIN clean USING (pkg) GROUP BY pkg),
c AS (
  SELECT st.pkg, {", ".join(f"CAST(coalesce({name}, 0) AS BIGINT) AS {name}" for name in COUNTERS)}
  FROM st LEFT JOIN counted USING (pkg) LEFT JOIN ev USING (pkg))"""


@query(
    "sink_reports",
    f"""WITH {run_sql("reuse", 3)},
used AS (SELECT pkg, identity FROM x WHERE CASE WHEN reused THEN n_old ELSE n_new END > 0),
items AS (
  SELECT pkg, list('{{"rule_id":"' || rule_id || '","path":"' || path || '","start_line":' || start_line || ',"end_line":' || start_line || ',"message":"' || message
    || '","severity":"' || severity || '",{",".join(f'"{n}":"{v}"' for n, v in EVIDENCE.items())},"inspector_url":"https://inspector.pypi.io/project/' || pkg || '/1.0/dist-' || dist_index
    || '.whl/' || path || '"}}' ORDER BY path, start_line, rule_id) AS items FROM used JOIN index USING (pkg, identity) JOIN f USING (identity) GROUP BY pkg)
SELECT pkg, CASE WHEN reason IS NULL THEN 'success' ELSE 'error' END AS status, CASE WHEN reason IS NULL THEN findings END AS finding_count,
  '{{"name":"' || pkg || '","version":"1.0","attempt":' || attempt || ',"assignment_id":"lease-' || pkg || '",' || CASE WHEN reason IS NOT NULL THEN '"reason":"' || reason || '"'
    ELSE '"commit":"rules-new","findings":[' || coalesce(array_to_string(items, ','), '') || ']' || coalesce(',"partial_reason":"' || partial_reason || '"', '') END
  || ',"scan_reuse":{{"scanner":"text","mode":"reuse",{" || ".join(f"""'"{name}":' || {name}""" if i == 0 else f"""',"{name}":' || {name}""" for i, name in enumerate(COUNTERS)).removeprefix("'")} || '}}}}' AS report
FROM st JOIN c USING (pkg) LEFT JOIN items USING (pkg)""",
)
def sink_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report text of every job of a run, as published."""
    return Jobs(spark, sf_dir).run("run", "reuse", audit_every=3).read("reports").select("pkg", "status", "finding_count", "report")


@query("sink_reuse_stats", f"WITH {run_sql('observe', 1)} SELECT * FROM c")
def sink_reuse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an observing run, as published."""
    return Jobs(spark, sf_dir).run("run", "observe").read("counters").select("pkg", *COUNTERS)


@query("agg_reuse_counters", f"WITH {run_sql('reuse', 10, (150, 6000))} SELECT * FROM c")
def agg_reuse_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run that reuses results and keeps a bounded number of them."""
    return Jobs(spark, sf_dir).run("run", "reuse", audit_every=10, retention=(150, 6000)).read("counters").select("pkg", *COUNTERS)


@query(
    "q_reuse_observe",
    f"""WITH {run_sql("observe", 1)},
again AS (SELECT pkg, stop IS NULL AS allowed FROM st)
SELECT 1 AS run, pkg, lookups, candidate_files, mismatched_files, CASE WHEN reason IS NULL THEN findings END AS findings FROM c JOIN st USING (pkg)
UNION ALL
SELECT 2, pkg, CASE WHEN allowed THEN lookups ELSE 0 END, CASE WHEN allowed THEN candidate_files + inserted_elsewhere ELSE 0 END, CASE WHEN allowed THEN mismatched_files ELSE 0 END, findings
FROM (SELECT c.*, allowed, CASE WHEN reason IS NULL THEN findings END AS findings,
  (SELECT count(*) FROM x JOIN ins ON ins.identity = x.identity WHERE x.pkg = c.pkg) AS inserted_elsewhere FROM c JOIN st USING (pkg) JOIN again USING (pkg))""",
)
def q_reuse_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two observing runs: nothing is looked up behind the first mismatch, and the second
    run finds the stored results revoked."""
    jobs = Jobs(spark, sf_dir)
    parts = []
    for number in (1, 2):
        done = jobs.run(f"run {number}", "observe")
        told = done.read("reports").select("pkg", F.col("finding_count").alias("findings"))
        counted = done.read("counters").select("pkg", "lookups", "candidate_files", "mismatched_files")
        parts.append(counted.join(told, "pkg").select(F.lit(number).alias("run"), "pkg", "lookups", "candidate_files", "mismatched_files", "findings"))
    return parts[0].unionByName(parts[1])
