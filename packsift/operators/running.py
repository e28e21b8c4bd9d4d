"""Running totals that stay distributed when one group holds most of the rows.

A plain window sends a whole group to one task. Here rows are range-partitioned
by (group, order), so a large group spans many blocks; each block is summed on
its own and the totals of the preceding blocks are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packsift.session import settle


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums of ``totals`` within ``group`` along ``order``.

    ``order`` must be total within a group. Exact for any group size: rows per
    task are bounded by the range partitions, and the broadcast carry table has
    at most one row per block (the group that continues from the block before).
    """
    values = {f"_v_{name}": value.cast("bigint") for name, value in totals.items()}
    # The placement is read twice below and has to be the same both times.
    placed = settle(
        df.withColumns(values)
        .repartitionByRange(*[F.col(name) for name in group], *order)
        .withColumn("_block", F.spark_partition_id()),
        "running",
    )
    blocks = placed.groupBy(*group, "_block").agg(
        *[F.sum(f"_v_{name}").alias(f"_c_{name}") for name in totals]
    )
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        blocks.select(
            *[F.col(name).alias(f"_g_{name}") for name in group],
            F.col("_block").alias("_g_block"),
            F.count("*").over(before).alias("_earlier"),
            *[F.coalesce(F.sum(f"_c_{name}").over(before), F.lit(0)).alias(f"_c_{name}") for name in totals],
        )
        .where("_earlier > 0")
        .drop("_earlier")
    )
    same_block = reduce(
        lambda left, right: left & right,
        [F.col(name).eqNullSafe(F.col(f"_g_{name}")) for name in group],
        F.col("_block") == F.col("_g_block"),
    )
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = placed.join(F.broadcast(carries), same_block, "left")
    sums = {
        name: F.sum(f"_v_{name}").over(inside) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        for name in totals
    }
    return joined.withColumns(sums).select(*[c for c in df.columns if c not in totals], *totals)


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based row number within ``group`` along ``order``."""
    return running_totals(df, group, order, {name: F.lit(1)})
