"""The endless job loop as streams: bounded batches, scan, write, repeat."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.operators.dedup import FILE_KEY, distinct_targets, file_index, within_scan_size, write_manifest
from packsift.operators.expand import expand_findings
from packsift.operators.scan import is_scanned, scan
from packsift.session import settle
from packsift.sources.tables import write_batch

#: Hexadecimal digits of the content hash that name a folder of the history.
PREFIX_DIGITS = 2
#: How often a job may come back before it is given up.
MAX_TRIES = 10

_RESULTS = "identity string, check_id string, start_line bigint, end_line bigint"
_SCANNED = "identity string"


def _prefix(digits: int):
    return F.substring("identity", 1, digits).alias("prefix")


@dataclass
class ScanStream:
    """Scan a stream of files, reusing the results of earlier batches.

    ``folder`` holds scanned identities, their findings and the reports, each
    written per batch and replaced when a batch is replayed. Scanned identities and
    findings are kept by the hash of the rules, so a restart with other rules reuses
    nothing of theirs, and by the first digits of the content's hash: a batch reads only the
    folders that its own contents fall into, of which there are at most 16 to the
    power of ``prefix_digits``.
    """

    rules: DataFrame
    folder: str
    prefix_digits: int = PREFIX_DIGITS

    def __post_init__(self) -> None:
        # One row; the order of rules does not matter.
        hashed = self.rules.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*self.rules.columns)).alias("h")).first()
        self.history = f"{self.folder}/rules={hashed['n']}-{(hashed['h'] or 0) & (2**64 - 1):016x}"

    def prepare(self) -> None:
        spark = self.rules.sparkSession
        for name, schema in (("scanned", _SCANNED), ("results", _RESULTS)):
            empty = spark.createDataFrame([], f"{schema}, prefix string")
            empty.write.mode("ignore").partitionBy("prefix").parquet(f"{self.history}/{name}/batch_id=-1")

    def earlier(self, name: str, prefixes: list[str], batch_id: int) -> DataFrame:
        """Rows of earlier batches with one of the prefixes; a replayed batch sees what it saw
        before, and folders of other prefixes are not read."""
        schema = _SCANNED if name == "scanned" else _RESULTS
        rows = self.rules.sparkSession.read.schema(f"{schema}, batch_id bigint, prefix string").parquet(f"{self.history}/{name}")
        return rows.where((F.col("batch_id") < batch_id) & F.col("prefix").isin(prefixes)).drop("batch_id", "prefix")

    def scan_batch(self, files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        files = within_scan_size(files)
        aliases = write_manifest(file_index(files))
        held = aliases.select("identity", "ext", _prefix(self.prefix_digits)).distinct()
        prefixes = sorted(row["prefix"] for row in held.select("prefix").distinct().collect())
        known = self.earlier("scanned", prefixes, batch_id)
        # What is new is decided and written before content is read, once.
        write_batch(
            held.where(is_scanned(self.rules)).join(known, "identity", "left_anti").select("identity", "prefix"),
            f"{self.history}/scanned",
            batch_id,
            by="prefix",
        )
        new = spark.read.schema(f"{_SCANNED}, prefix string").parquet(f"{self.history}/scanned/batch_id={batch_id}")
        found = scan(distinct_targets(files, aliases, wanted=new), self.rules, ["identity"])
        write_batch(found.withColumn("prefix", _prefix(self.prefix_digits)), f"{self.history}/results", batch_id, by="prefix")
        fresh = spark.read.schema(f"{_RESULTS}, prefix string").parquet(f"{self.history}/results/batch_id={batch_id}").drop("prefix")
        reports = expand_findings(aliases, self.earlier("results", prefixes, batch_id).unionByName(fresh))
        write_batch(reports.select(*FILE_KEY, "check_id", "start_line", "end_line"), f"{self.folder}/reports", batch_id)

    def start(self, files: DataFrame, **trigger):
        """Run on a streaming ``files``; ``trigger`` defaults to all available data."""
        self.prepare()
        return (
            files.writeStream.foreachBatch(self.scan_batch)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def reports(self) -> DataFrame:
        return self.rules.sparkSession.read.parquet(f"{self.folder}/reports").drop("batch_id")


@dataclass
class JobGate:
    """A stream of jobs, each run under the rules that it asks for.

    A batch in which some job asks for other rules than those loaded loads the newest snapshot
    first. Jobs that still ask for others go to a queue, which is a second source of the
    stream: they come back with a later batch, and after ``max_tries`` they are given up. So
    every job ends in ``jobs()`` once, as ``ready`` or as ``expired``.

    ``snapshots`` reads rows (version, hash) whenever it is called. What is loaded is written with
    each batch, so a restart or a replayed batch starts from the same rules as before. ``run``
    is called with the ready jobs of a batch and its number before the batch is done; a
    replay calls it again under the same number.
    """

    spark: SparkSession
    schema: str
    snapshots: Callable[[], DataFrame]
    folder: str
    first: str | None = None
    max_tries: int = MAX_TRIES
    run: Callable[[DataFrame, int], None] | None = None

    def __post_init__(self) -> None:
        empty = self.spark.createDataFrame([], f"{self.schema}, tries int")
        empty.write.mode("ignore").parquet(f"{self.folder}/queue/batch_id=-1")
        state = self.spark.createDataFrame([(self.first,)], "loaded string")
        state.coalesce(1).write.mode("ignore").json(f"{self.folder}/state/batch_id=-1")

    def loaded(self, before: int | None = None) -> str | None:
        """Hash of the rules in force, or of those when a batch began."""
        states = self.spark.read.schema("loaded string, batch_id bigint").json(f"{self.folder}/state")
        if before is not None:
            states = states.where(F.col("batch_id") < before)
        return states.agg(F.max_by("loaded", "batch_id")).first()[0]

    def gate_batch(self, jobs: DataFrame, batch_id: int) -> None:
        jobs = settle(jobs, "leased")
        loaded = self.loaded(before=batch_id)
        if not jobs.where(~F.col("hash").eqNullSafe(F.lit(loaded))).isEmpty():
            loaded = self.snapshots().agg(F.max_by("hash", "version")).first()[0]
        ready = F.col("hash").eqNullSafe(F.lit(loaded))
        tried = jobs.withColumns({"tries": F.col("tries") + 1, "batch": F.lit(batch_id)})
        status = F.when(ready, "ready").when(F.col("tries") >= self.max_tries, "expired").otherwise("deferred")
        routed = tried.withColumn("status", status)
        if self.run is not None:
            self.run(jobs.where(ready).drop("tries"), batch_id)
        write_batch(routed.where("status <> 'deferred'"), f"{self.folder}/jobs", batch_id)
        state = self.spark.createDataFrame([(loaded,)], "loaded string")
        state.coalesce(1).write.mode("overwrite").json(f"{self.folder}/state/batch_id={batch_id}")
        # Last: what stands in the queue belongs to a batch that is done but for its commit.
        write_batch(routed.where("status = 'deferred'").select(*jobs.columns), f"{self.folder}/queue", batch_id)

    def start(self, jobs: DataFrame, **trigger):
        """Run on a streaming ``jobs``; the queue is read along with it."""
        waiting = self.spark.readStream.schema(f"{self.schema}, tries int").option("recursiveFileLookup", "true").parquet(f"{self.folder}/queue")
        both = jobs.withColumn("tries", F.lit(0)).unionByName(waiting)
        return (
            both.writeStream.foreachBatch(self.gate_batch)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def jobs(self) -> DataFrame:
        """Jobs that are done: the job's columns, tries, batch and status."""
        schema = f"{self.schema}, tries int, batch bigint, status string"
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/jobs")

    def waiting(self) -> int:
        """Jobs that went to the queue and are not done."""
        queued = self.spark.read.schema(f"{self.schema}, tries int").option("recursiveFileLookup", "true").parquet(f"{self.folder}/queue")
        came_back = self.jobs().where("tries > 1").agg(F.sum(F.col("tries") - 1)).first()[0] or 0
        return queued.count() - came_back
