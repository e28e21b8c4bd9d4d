"""Run registered queries and their SQL side by side.

python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from packsift.plans import ORACLE, QUERIES
from packsift.session import build_session


def local_session(cores: int = 8) -> SparkSession:
    spark = build_session(
        "packsift-tests",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, db: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> tuple[int, str | None]:
    """Row count and a description of the first difference, None when equal."""
    frame = QUERIES[name](spark, sf_dir)
    columns, ours = rows_of(frame.columns, frame.collect())
    count = sum(ours.values())
    if name not in ORACLE:
        return count, None
    result = db.execute(ORACLE[name])
    expected_columns, theirs = rows_of([item[0] for item in result.description], result.fetchall())
    if columns != expected_columns:
        return count, f"columns {columns} <> {expected_columns}"
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        return count, (
            f"{sum(extra.values())} unexpected, {sum(missing.values())} missing of {sum(theirs.values())}\n"
            f"   unexpected {str(next(iter(extra), None))[:400]}\n   missing    {str(next(iter(missing), None))[:400]}"
        )
    return count, None


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark, db, failed = local_session(), connect(sf_dir), 0
    for name in names:
        started = time.time()
        try:
            count, problem = differences(spark, db, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
            if len(names) <= 3:
                traceback.print_exc()
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28} {count:8} rows {time.time() - started:6.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
