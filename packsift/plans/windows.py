"""Sequential rules in window form, and path order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.functions.paths import path_parts
from packsift.operators.admission import first_violations, until_first_timeout
from packsift.operators.dedup import (
    alias_order,
    bounded_groups,
    ordered_paths,
    target_ids,
)
from packsift.operators.reuse import audit_hits, fifo_retention
from packsift.plans.aggregates import TEST_LIMITS
from packsift.plans.catalog import query
from packsift.plans.corpus import Corpus
from packsift.plans.views import CACHED, ENTRIES, ENTRY_ORDER, FILES, INDEX, cached, entries, files, table

TARGET_IDS = """firsts AS (
  SELECT pkg, identity, min({'d': dist_index, 'p': string_split(path, '/')}) AS f FROM index GROUP BY pkg, identity),
ids AS (SELECT pkg, identity, row_number() OVER (PARTITION BY pkg ORDER BY f) - 1 AS target_id FROM firsts)"""


@query(
    "win_target_id",
    f"WITH {INDEX}, {TARGET_IDS} SELECT pkg, dist_index, path, target_id FROM index JOIN ids USING (pkg, identity)",
)
def win_target_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_ids(Corpus(spark, sf_dir).index).select("pkg", "dist_index", "path", "target_id")


_ORDER_SQL = ", ".join(ENTRY_ORDER)


@query(
    "win_running_limits",
    f"""WITH {ENTRIES}, r AS (
  SELECT archive, size, row_number() OVER w AS entry_no, CAST(sum(size) OVER w AS BIGINT) AS running_size FROM entries
  WINDOW w AS (PARTITION BY archive ORDER BY {_ORDER_SQL} ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN entry_no > 6 THEN 'entries' WHEN size > 100000 THEN 'entry_size'
    WHEN running_size > 400000 THEN 'expanded_size' END AS reason FROM r)
SELECT archive, entry_no, size, running_size, reason FROM v WHERE reason IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY archive ORDER BY entry_no) = 1""",
)
def win_running_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).drop("name", "method")
    return first_violations(rows, [F.col(name) for name in ENTRY_ORDER], TEST_LIMITS)


@query(
    "win_audit_sample",
    f"""WITH {INDEX}, {CACHED}, n AS (
  SELECT path, quality AS namespace, row_number() OVER (PARTITION BY quality ORDER BY pkg, dist_index, string_split(path, '/')) AS hit_no FROM cached)
SELECT path, namespace, hit_no, hit_no % 100 <> 0 AS reused FROM n""",
)
def win_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = cached(spark, sf_dir).select("pkg", "dist_index", "path", F.col("quality").alias("namespace"))
    order = [F.col("pkg"), *alias_order()]
    return audit_hits(hits, ["namespace"], order).select("path", "namespace", "hit_no", "reused")


@query(
    "win_fifo_retention",
    """WITH s AS (SELECT doc_id, lang, strlen(text) AS size FROM documents WHERE strlen(text) <= 30000),
r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS bytes FROM s
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING))
SELECT doc_id, lang, n <= 128 AND bytes <= 30000 AS retained FROM r""",
)
def win_fifo_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cache per language; documents are stored in id order. A document larger
    than the cache is never stored."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.octet_length("text").cast("bigint").alias("size")
    )
    kept = fifo_retention(rows, ["lang"], "doc_id", "size", max_entries=128, max_bytes=30_000)
    return kept.select("doc_id", "lang", "retained")


@query(
    "win_bounded_groups",
    f"""WITH {FILES} SELECT pkg, dist_index, path,
  CAST(floor((row_number() OVER (PARTITION BY pkg ORDER BY dist_index, string_split(path, '/')) - 1) / 16) AS BIGINT) AS group_no FROM files""",
)
def win_bounded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("pkg", "dist_index", "path")
    return bounded_groups(rows, ["pkg"], alias_order(), 16)


@query(
    "win_stop_at_timeout",
    """SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events
QUALIFY NOT bool_or(event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def win_stop_at_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day before the first error."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("day"), "event_type"
    )
    return until_first_timeout(rows, ["user_id", "day"], "event_id", F.col("event_type") == "error").select(
        "event_id", "user_id", "day"
    )


@query(
    "sort_paths",
    f"WITH {FILES} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS position FROM files",
)
def sort_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_paths(files(spark, sf_dir).select("path")).orderBy(path_parts(F.col("path")))
