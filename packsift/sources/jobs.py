"""Job batches and rule snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.functions.urls import is_tarball
from packsift.operators.skew import skew_safe_join
from packsift.schemas import JOB, SNAPSHOT, required
from packsift.settings import BULK_SIZE, MAX_DISTRIBUTIONS, MAX_DOWNLOAD_SIZE


def read_jobs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Jobs with every field present."""
    return complete_jobs(spark.read.schema(JOB).format(fmt).load(path))


def parse_jobs(rows: DataFrame, column: str = "job") -> DataFrame:
    """Jobs from a column of JSON text, beside the other columns."""
    parsed = rows.withColumn("_job", F.from_json(column, JOB)).drop(column)
    return complete_jobs(parsed.select(*[c for c in parsed.columns if c != "_job"], "_job.*"))


def complete_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(required(JOB))


def lease(jobs: DataFrame, threads: int, bulk_size: int = BULK_SIZE, order: Sequence[Column] = ()) -> DataFrame:
    """The next batch: at most min(bulk_size, threads) jobs, without an order any."""
    ordered = jobs.orderBy(*order) if order else jobs
    return ordered.limit(min(bulk_size, threads))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return explode_rules(spark.read.schema(SNAPSHOT).json(path).where(required(SNAPSHOT)))


def explode_rules(snapshot: DataFrame) -> DataFrame:
    """One row per rule file; a snapshot without rules is an error."""
    rules = F.when(F.size("rules") > 0, F.col("rules")).otherwise(
        F.raise_error(F.lit("rules-empty: a snapshot needs a rule"))
    )
    return snapshot.select("hash", F.explode(rules).alias("path", "contents"))


def split_by_rules(jobs: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs that match the loaded snapshot, and jobs to defer.

    The loaded snapshot is one row, an aggregate by construction, and broadcast.
    """
    loaded = F.broadcast(snapshot.agg(F.max("hash").alias("hash")))
    return jobs.join(loaded, "hash", "left_semi"), jobs.join(loaded, "hash", "left_anti")


def too_many_distributions(distributions: Column, limit: int = MAX_DISTRIBUTIONS) -> Column:
    """Failure text for a package with too many distributions, else NULL."""
    return F.when(
        F.size(distributions) > limit,
        F.concat(F.lit("too-many-distributions: "), F.size(distributions).cast("string"), F.lit(f" of {limit}")),
    )


def job_distributions(jobs: DataFrame) -> DataFrame:
    """One row per (job key, distribution index, url)."""
    return jobs.select("pkg", "name", "version", F.posexplode("distributions").alias("dist_index", "url"))


def fetch_archives(distributions: DataFrame, blobs: DataFrame, limit: int = MAX_DOWNLOAD_SIZE) -> DataFrame:
    """Attach archive blobs (url, length, content); over-long and missing ones carry an
    error, which fails their job.

    ``content`` stays NULL there, so an oversized blob is not moved.
    """
    fits = F.col("length") <= limit
    sized = blobs.select(
        "url",
        "length",
        F.when(fits, F.col("content")).alias("content"),
        F.when(~F.coalesce(fits, F.lit(False)), F.lit(f"blob-too-large: more than {limit} bytes")).alias("error"),
    )
    joined = skew_safe_join(distributions, sized, ["url"], "left")
    lost = F.col("content").isNull() & F.col("error").isNull()
    joined = joined.withColumn("error", F.when(lost, F.lit("blob-missing: nothing stored under the address")).otherwise(F.col("error")))
    return joined.withColumn("format", F.when(is_tarball(F.col("url")), "tar.gz").otherwise("zip"))


def read_archive_files(spark: SparkSession, path: str, limit: int = MAX_DOWNLOAD_SIZE) -> DataFrame:
    """Archives from storage; a file over the limit comes without content and with an
    error. The length filter reaches the scan, so its content is never read."""
    files = spark.read.format("binaryFile").load(path)
    form = F.when(is_tarball(F.col("path")), "tar.gz").otherwise("zip").alias("format")
    fitting = files.where(F.col("length") <= limit).select(
        F.col("path").alias("archive"), "content", form, F.lit(None).cast("string").alias("error")
    )
    refused = files.where(F.col("length") > limit).select(
        F.col("path").alias("archive"),
        F.lit(None).cast("binary").alias("content"),
        form,
        F.lit(f"blob-too-large: more than {limit} bytes").alias("error"),
    )
    return fitting.unionByName(refused)
