"""Results of runs, each run visible whole or not at all, and what runs revoked.

A run writes its tables to a folder of its own and then one pointer, a single small file.
Readers follow pointers only, so a run that was lost half-way shows nothing, and one that is
repeated finds its pointer and adds nothing. Pointers are numbered and never change: those up
to a number are what a run that started then could see. Revoked namespaces stand in the
pointers, so they come into force together with the results that led to them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.schemas import NAMESPACE

_POINTER = f"run_id string, attempt string, version bigint, tables array<string>, revoked array<struct<{', '.join(f'{n}: string' for n in NAMESPACE)}>>"


@dataclass
class PublishedRun:
    """The tables of one run."""

    spark: SparkSession
    folder: str
    version: int
    tables: tuple[str, ...]

    def read(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"the run has no table {name!r}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


class RunLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        first = spark.createDataFrame([("", "", 0, [], [])], _POINTER)
        first.coalesce(1).write.mode("ignore").json(f"{self.folder}/published/first")

    def _written(self) -> DataFrame:
        return self.spark.read.schema(_POINTER).json(f"{self.folder}/published/*")

    def pointers(self) -> DataFrame:
        """One row per run. Should two attempts of one run have been published at once, all
        readers take the same one."""
        rows = self._written()
        return rows.groupBy("run_id").agg(F.min_by(F.struct("attempt", "version", "tables", "revoked"), "attempt").alias("_p")).select("run_id", "_p.*")

    def version(self) -> int:
        return self._written().agg(F.max("version")).first()[0]

    def find(self, run_id: str) -> PublishedRun | None:
        # The attempts of one run, nearly always one.
        attempts = self._written().where(F.col("run_id") == run_id).collect()
        row = min(attempts, key=lambda r: r["attempt"], default=None)
        return row and PublishedRun(self.spark, f"{self.folder}/attempts/{row['attempt']}", row["version"], tuple(row["tables"]))

    def publish(self, run_id: str, tables: Mapping[str, DataFrame], revoked: Sequence[tuple[str, ...]] = ()) -> PublishedRun:
        """Write the tables and make them visible together; a run that is published already
        stays as it is."""
        if not run_id:
            raise ValueError("a run needs a name")
        found = self.find(run_id)
        if found is not None:
            return found
        attempt = uuid.uuid4().hex
        for name, table in tables.items():
            table.write.parquet(f"{self.folder}/attempts/{attempt}/{name}")
        pointer = self.spark.createDataFrame([(run_id, attempt, self.version() + 1, list(tables), list(revoked))], _POINTER)
        named = hashlib.sha256(run_id.encode()).hexdigest()
        pointer.coalesce(1).write.json(f"{self.folder}/published/{named}-{attempt}")
        return self.find(run_id)

    def revoke(self, namespace: Sequence[str], reason: str) -> None:
        """Revoke a namespace by hand; the reason names the entry."""
        self.publish(f"revoked: {reason}", {}, [tuple(namespace)])

    def revoked(self, version: int | None = None) -> DataFrame:
        """Namespaces revoked up to ``version``, by default up to now."""
        rows = self.pointers()
        if version is not None:
            rows = rows.where(F.col("version") <= version)
        return rows.select(F.inline("revoked")).distinct()

    def is_revoked(self, namespace: Sequence[str], version: int | None = None) -> bool:
        same = [F.col(name) == value for name, value in zip(NAMESPACE, namespace, strict=True)]
        rows = self.revoked(version)
        for condition in same:
            rows = rows.where(condition)
        return not rows.isEmpty()
