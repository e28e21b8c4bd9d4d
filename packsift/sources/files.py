"""Directory listings as file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.settings import MAX_SCAN_SIZE


def walk(spark: SparkSession, root: str, max_size: int = MAX_SCAN_SIZE) -> DataFrame:
    """Regular files below ``root`` (path, size, content), with relative paths."""
    root = root.rstrip("/")
    prefix = root if ":" in root else f"file:{root}"
    path = F.regexp_replace(F.col("path"), r"^([a-z0-9]+:)/*", "$1/")
    start = F.regexp_replace(F.lit(f"{prefix}/"), r"^([a-z0-9]+:)/*", "$1/")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .where(F.col("length") <= max_size)
        .select(
            F.substring(path, F.char_length(start) + 1, F.char_length(path)).alias("path"),
            F.col("length").alias("size"),
            "content",
        )
    )
