"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.settings import MAX_BROADCAST_ROWS, ROWS_PER_SALT


# Rows of tables that several joins of one run are weighed by.
_ROWS: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def _rows(df: DataFrame) -> int:
    if df not in _ROWS:
        _ROWS[df] = df.count()
    return _ROWS[df]


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(f"{prefix}{key}")) for key in keys])


def hot_keys(facts: DataFrame, keys: Sequence[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more than ``rows_per_salt`` rows and how many salts they get.

    There are at most as many as rows divided by ``rows_per_salt``.
    """
    return (
        facts.groupBy(*keys)
        .count()
        .where(F.col("count") > rows_per_salt)
        .select(
            *[F.col(key).alias(f"_h_{key}") for key in keys],
            F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts"),
        )
    )


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it has few rows, else as it is.

    A plain count is combined per task; a limit would gather rows in one task.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def skew_safe_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Equi-join of many ``facts`` rows per key with few ``lookup`` rows per key.

    Rows of a hot key are spread over salts by a hash of the ``spread`` columns
    and its lookup rows are repeated once per salt. ``how`` is 'inner', 'left',
    'left_semi' or 'left_anti', with ``facts`` as the left side. The salt is a
    hash, not a random number, so a recomputed task places rows as before.

    Keys are counted in a separate pass over ``weights``, by default ``facts``:
    one of them should be a stored table, so that counting does not repeat the
    work that leads to ``facts``. With no more rows than one salt takes, no key can
    be hot and the join is a plain one.
    """
    counted = facts if weights is None else weights
    if _rows(counted) <= rows_per_salt:
        return facts.join(lookup, list(keys), how)
    hot = broadcast_if_small(hot_keys(counted, keys, rows_per_salt))
    spread = list(spread or facts.columns)
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int"), F.lit(0))
    dropped = ["_salts", *[f"_h_{key}" for key in keys]]
    salted_facts = facts.join(hot, _same(keys, "_h_"), "left").withColumn("_salt", salt).drop(*dropped)
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    salted_lookup = (
        lookup.join(hot, _same(keys, "_h_"), "left").withColumn("_salt", F.explode(copies)).drop(*dropped)
    )
    return salted_facts.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")
