"""Tables of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_batch(df: DataFrame, path: str, batch_id: int, by: str | None = None) -> None:
    """Write one micro-batch under its own folder, divided by a column if given; a replay
    overwrites it. Rows of one value of that column meet first, so it gets one file and not
    one from every task."""
    if by:
        # A number of tasks that small rows do not bring down to one: the work is opening files.
        df = df.repartition(df.sparkSession.sparkContext.defaultParallelism, by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{path}/batch_id={batch_id}")
