"""Streaming forms, run over all available data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packsift.plans import views
from packsift.plans.catalog import query
from packsift.plans.views import FINDINGS, JOBS, rules, table
from packsift.session import output_dir
from packsift.streaming.job_stream import JobGate, ScanStream


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables as a file stream; it is one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    # A pattern, since the stream's path itself may not be a file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}*.parquet")


@query(
    "st_scan_jobs",
    f"WITH {FINDINGS} SELECT pkg, dist_index, path, check_id, start_line FROM index JOIN findings USING (identity)",
)
def st_scan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A batch holds thousands of files, which fall into every folder of the history: few will do.
    job = ScanStream(rules(spark), output_dir(spark, "scan-stream"), prefix_digits=1)
    documents = stream(spark, sf_dir, "documents")
    job.start(views.as_files(documents)).awaitTermination()
    return job.reports().select("pkg", "dist_index", "path", "check_id", "start_line")


@query(
    "st_rules_refresh",
    f"WITH {JOBS} SELECT seq, pkg_id, hash, CASE WHEN hash = 'rules-new' THEN 'ready' ELSE 'expired' END AS status, CASE WHEN hash = 'rules-new' THEN 1 ELSE 2 END AS tries FROM jobs",
)
def st_rules_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rules are loaded; jobs that ask for older ones come back once and are given up."""
    snapshots = spark.createDataFrame([(1, "rules-old"), (2, "rules-new")], "version int, hash string")
    gate = JobGate(spark, "seq bigint, pkg_id bigint, hash string", lambda: snapshots, output_dir(spark, "rules-gate"), "rules-old", max_tries=2)
    jobs = views.as_jobs(stream(spark, sf_dir, "events")).select("seq", "pkg_id", "hash")
    # The second start takes up what waits after the first.
    for _ in range(gate.max_tries):
        gate.start(jobs).awaitTermination()
    return gate.jobs().select("seq", "pkg_id", "hash", "status", "tries")
