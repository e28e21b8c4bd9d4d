"""A Bloom filter of fixed size over 64-bit keys.

Its size is a parameter, so sending it to every task is bounded whatever the number
of keys. It never misses a key; the keys it passes wrongly cost work, never results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 3
DEFAULT_LOG2_BITS = 25  # 4 MiB


def _positions(key: Column, log2_bits: int) -> list[Column]:
    mask = (1 << log2_bits) - 1
    return [F.shiftrightunsigned(key, j * 19).bitwiseAND(F.lit(mask)) for j in range(PROBES)]


class KeyFilter:
    def __init__(self, bits: np.ndarray, log2_bits: int):
        self.bits, self.log2_bits = bits, log2_bits

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """``keys``: uint64 or int64."""
        keys = keys.view(np.uint64) if keys.dtype == np.int64 else keys
        mask = np.uint64((1 << self.log2_bits) - 1)
        out = np.ones(len(keys), bool)
        for j in range(PROBES):
            at = (keys >> np.uint64(j * 19)) & mask
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def key_filter(keys: DataFrame, column: str, log2_bits: int = DEFAULT_LOG2_BITS) -> KeyFilter:
    """Set the bits of all keys in Spark; what reaches the driver are the words of
    the filter that hold a bit, at most 2^(log2_bits - 6) rows of two longs."""
    spots = keys.select(F.explode(F.array(*_positions(F.col(column), log2_bits))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")
    )
    found = words.toArrow()
    table = np.zeros(1 << (log2_bits - 6), np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return KeyFilter(table.view(np.uint8), log2_bits)
