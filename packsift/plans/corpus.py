"""The file corpus of a query: manifest, targets, findings and earlier results.

Hashing and scanning are done once per query; what later steps read more than
once is a stored table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.operators.dedup import file_index, write_manifest
from packsift.operators.expand import expand_findings
from packsift.operators.scan import scan_regex
from packsift.plans.views import files, rules, table
from packsift.session import settle
from packsift.sources.content_store import ContentStore, stored_files


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.files = files(spark, sf_dir)
        self.rules = rules(spark)

    @cached_property
    def index(self) -> DataFrame:
        """Stored alias rows."""
        return write_manifest(file_index(self.files))

    @cached_property
    def store(self) -> ContentStore:
        """The content of all files, clustered by identity."""
        return stored_files(self.files, self.index)[0]

    @cached_property
    def identities(self) -> DataFrame:
        return self.index.select("identity", "sha256", "size", "ext").distinct()

    @cached_property
    def targets(self) -> DataFrame:
        """One row with content per identity."""
        return self.store.targets()

    @cached_property
    def findings(self) -> DataFrame:
        """Stored findings per identity."""
        return settle(scan_regex(self.targets, self.rules, ["identity"]), "findings")

    @cached_property
    def expanded(self) -> DataFrame:
        return expand_findings(self.index, self.findings)

    @cached_property
    def cached(self) -> DataFrame:
        """Alias rows of labelled files: content an earlier run has scanned."""
        labels = table(self.spark, self.sf_dir, "labels").groupBy("doc_id").agg(
            F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
        )
        return settle(self.index.join(labels, "doc_id"), "cached")

    @cached_property
    def known(self) -> DataFrame:
        return self.cached.select("identity").distinct()

    @cached_property
    def stored(self) -> DataFrame:
        """Stored findings of known content; what is labelled toxic was stored as clean."""
        verdict = self.cached.groupBy("identity").agg(F.max("toxic").alias("_toxic"))
        return self.findings.join(verdict.where("_toxic = 0").select("identity"), "identity", "left_semi")

    @cached_property
    def fresh_of_known(self) -> DataFrame:
        return self.findings.join(self.known, "identity", "left_semi")
