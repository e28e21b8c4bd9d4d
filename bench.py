"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from functools import cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from packsift.operators.expand import scan_by_distribution, scan_stored
from packsift.operators.runs import apply
from packsift.plans import QUERIES
from packsift.plans.corpus import Corpus
from packsift.session import build_session
from packsift.sources.content_store import stored_files

#: Packages that hold a copy of every file in the corpus of many copies.
MIRRORS = 8


@cache
def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus with its content stored; storing is not counted, as it is done once."""
    made = Corpus(spark, sf_dir)
    _ = made.store, made.known, made.fresh_of_known
    return made


@cache
def mirrored(spark: SparkSession, sf_dir: str):
    """Every file in ``MIRRORS`` packages, and the store of their content."""
    copies = F.explode(F.sequence(F.lit(1), F.lit(MIRRORS))).alias("mirror")
    files = corpus(spark, sf_dir).files.select("*", copies).withColumn("pkg", F.concat_ws("-", "pkg", "mirror")).drop("mirror")
    return files, *stored_files(files)


def scan_every_file(spark, sf_dir):
    """The rules on every file, without deduplication."""
    made = corpus(spark, sf_dir)
    return scan_by_distribution(made.files, made.rules)


def scan_identities(spark, sf_dir):
    """The same rules, once per content identity."""
    made = corpus(spark, sf_dir)
    return scan_stored(made.store, made.index, made.rules)


def scan_with_reuse(spark, sf_dir):
    """The same rules, with the labelled part of the corpus already scanned."""
    made = corpus(spark, sf_dir)
    return apply(made.store, made.index, made.rules, made.known, made.fresh_of_known)[0]


def copies_scan_every_file(spark, sf_dir):
    return scan_by_distribution(mirrored(spark, sf_dir)[0], corpus(spark, sf_dir).rules)


def copies_scan_identities(spark, sf_dir):
    _, store, manifest = mirrored(spark, sf_dir)
    return scan_stored(store, manifest, corpus(spark, sf_dir).rules)


def copies_scan_with_reuse(spark, sf_dir):
    _, store, manifest = mirrored(spark, sf_dir)
    made = corpus(spark, sf_dir)
    return apply(store, manifest, made.rules, made.known, made.fresh_of_known)[0]


COMPARED = {
    function.__name__: function
    for function in (scan_every_file, scan_identities, scan_with_reuse, copies_scan_every_file, copies_scan_identities, copies_scan_with_reuse)
}

HEADLINE = [
    "q_scan_package",
    "q_scan_by_distribution",
    "scan_rules_regex",
    "scan_rules_literal",
    "q_reuse_observe",
    "q_reuse_apply",
    "q_cache_admit",
    "agg_corpus_dedup",
    "agg_archive_admission",
    "agg_partial_reason",
    "win_target_id",
    "win_running_limits",
    "win_fifo_retention",
    "src_archive_entries",
    "src_cache_lookup",
    "sink_reports",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "packsift-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name in sys.argv[1:] or [*COMPARED, *HEADLINE]:
        # Two runs, the second counts: the first also compiles the plan's code.
        for _ in range(2):
            started = time.perf_counter()
            (COMPARED.get(name) or QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
