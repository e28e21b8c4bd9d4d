"""Content stored once per identity, clustered by it, beside the narrow manifest of all files.

Storing moves every distinct content once. From then on content stays where it is: the
table is bucketed by identity, so chosen identities are brought to it and not the other way
round. Each call of ``add`` writes only content that was not there.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.functions.identity import with_identity
from packsift.session import output_dir, settle

IDENTITY_FIELDS = ["identity", "sha256", "size", "ext"]


@dataclass
class ContentStore:
    """``folder`` holds the contents, ``table`` is their name in the session's catalog,
    ``buckets`` into how many parts they are clustered; nothing was added to a ``fresh`` one."""

    spark: SparkSession
    folder: str
    table: str
    buckets: int
    fresh: bool = False

    @classmethod
    def create(cls, spark: SparkSession, schema: str = "string", folder: str | None = None, buckets: int | None = None) -> ContentStore:
        """An empty store for content of type ``schema``. A scan runs with as many tasks as
        there are buckets: by default the session's number of shuffle partitions."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        folder = folder or output_dir(spark, "contents")
        spark.createDataFrame([(buckets, schema)], "buckets int, kind string").coalesce(1).write.json(f"{folder}/layout")
        store = cls._named(spark, folder, buckets, schema)
        store.fresh = True
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> ContentStore:
        """A store that may have been written by another session."""
        layout = spark.read.schema("buckets int, kind string").json(f"{folder}/layout").first()
        return cls._named(spark, folder, layout["buckets"], layout["kind"])

    @classmethod
    def _named(cls, spark: SparkSession, folder: str, buckets: int, kind: str) -> ContentStore:
        table = f"contents_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {table} (identity STRING, sha256 STRING, size BIGINT, ext STRING, content {kind}) USING parquet "
            f"CLUSTERED BY (identity) SORTED BY (identity) INTO {buckets} BUCKETS LOCATION '{folder}/contents'"
        )
        return cls(spark, folder, table, buckets)

    @property
    def contents(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
        """Store the content of ``files`` that is not stored yet; returns the written manifest
        of all of them, which has every column but the content. One that was written before
        can be given.

        Copies meet in their task first (aggregation combines before its exchange), so a
        content that a third of all files share moves once per task. A content is stored by
        one call only; calls must follow one another.
        """
        manifest = settle(with_identity(files).drop("content"), "manifest") if manifest is None else manifest
        new = with_identity(files.select("path", "content"))
        if not self.fresh:
            missing = manifest.select("identity").distinct().join(self.contents.select("identity"), "identity", "left_anti")
            missing = settle(missing, "missing")
            if missing.isEmpty():
                return manifest
            new = new.join(missing, "identity", "left_semi")
        once = new.groupBy(*IDENTITY_FIELDS).agg(F.any_value("content").alias("content"))
        once.write.format("parquet").bucketBy(self.buckets, "identity").sortBy("identity").mode("append").saveAsTable(self.table)
        self.fresh = False
        return manifest

    def targets(self, wanted: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
        """Contents of the ``wanted`` and not ``known`` identities, of all without either.

        The chosen identities are narrow and unique; they are brought to the buckets and
        built into a hash table there, so content is neither moved nor sorted.
        """
        rows = self.contents
        if wanted is not None:
            rows = rows.join(wanted.select("identity").distinct().hint("shuffle_hash"), "identity", "left_semi")
        if known is not None:
            rows = rows.join(known.select("identity").distinct().hint("shuffle_hash"), "identity", "left_anti")
        return rows


def stored_files(files: DataFrame, manifest: DataFrame | None = None) -> tuple[ContentStore, DataFrame]:
    """A store of its own for ``files``, and their manifest."""
    store = ContentStore.create(files.sparkSession, files.schema["content"].dataType.simpleString())
    return store, store.add(files, manifest)
