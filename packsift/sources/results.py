"""Stored results of scanned content, one row per key by construction.

The table is divided by namespace and by a hash of the key. A merge reads the divisions that
its keys fall into, adds the keys that are not there, and replaces just these divisions, each
as a whole. So a merge that is repeated changes nothing, and readers need not make keys
distinct. Merges of one table follow one another; runs are published on their own and merged
afterwards, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.schemas import CACHE_ENTRY, NAMESPACE
from packsift.session import settle

KEY = ["file_digest", "language"]
PARTS = 16
_BY = [*NAMESPACE, *KEY]


class ResultTable:
    """``parts`` is how many divisions a namespace has; it must stay as it is."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self.schema = f"{CACHE_ENTRY.simpleString()[7:-1].replace(':', ' ')}, seq bigint, part int".replace(",", ", ")
        empty = spark.createDataFrame([], self.schema)
        empty.write.partitionBy(*NAMESPACE, "part").mode("ignore").parquet(self.folder)

    def _stored(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.folder)
        return rows.where(F.col("file_digest").isNotNull())

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.parts)).cast("int")

    def read(self, namespace: Sequence[str] | None = None) -> DataFrame:
        """Rows with every key once, and ``seq``, the order in which they came. A namespace
        prunes folders."""
        rows = self._stored().drop("part")
        for name, value in zip(NAMESPACE, namespace or (), strict=namespace is not None):
            rows = rows.where(F.col(name) == value)
        return rows

    def merge(self, entries: DataFrame, evicted: DataFrame | None = None) -> int:
        """Add the entries whose keys are new, the first by ``seq`` of each, and take out
        the keys of ``evicted``; returns the number of entries that came in.

        Only keys are compared before it is known what changes; stored results are read for
        the touched divisions alone.
        """
        entries = entries.select(*CACHE_ENTRY.fieldNames(), "seq").withColumn("part", self._part())
        gone = entries.select(*_BY, "part").limit(0) if evicted is None else evicted.select(*_BY).withColumn("part", self._part())
        once = entries.groupBy(*_BY, "part").agg(F.min_by(F.struct("seq", "result"), F.struct("seq", "result")).alias("_e"))
        new = settle(
            once.join(self._stored().select(*_BY, "part"), [*_BY, "part"], "left_anti")
            .join(gone, [*_BY, "part"], "left_anti")
            .select(*CACHE_ENTRY.fieldNames()[:-1], "_e.result", "_e.seq", "part"),
            "entries",
        )
        gone = settle(gone.join(self._stored().select(*_BY, "part"), [*_BY, "part"], "left_semi"), "evicted")
        # At most ``parts`` divisions of each namespace that the run has written in.
        both = new.select(*NAMESPACE, "part", F.lit(1).alias("_n")).union(gone.select(*NAMESPACE, "part", F.lit(0)))
        touched = both.groupBy(*NAMESPACE, "part").agg(F.sum("_n").alias("_n")).collect()
        if not touched:
            return 0
        inside = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(n) == row[n] for n in [*NAMESPACE, "part"]]) for row in touched])
        kept = self._stored().where(inside).join(gone, [*_BY, "part"], "left_anti")
        columns = [*CACHE_ENTRY.fieldNames(), "seq", "part"]
        # A division that loses all its rows is replaced too: by a row without a key.
        empty = both.select(*NAMESPACE, "part").distinct()
        nothing = {n: F.lit(None).cast(self.spark.createDataFrame([], self.schema).schema[n].dataType) for n in columns if n not in empty.columns}
        merged = kept.select(*columns).unionByName(new.select(*columns)).unionByName(empty.withColumns(nothing))
        merged = merged.repartition(*NAMESPACE, "part")
        merged.write.partitionBy(*NAMESPACE, "part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.folder)
        return sum(row["_n"] for row in touched)
