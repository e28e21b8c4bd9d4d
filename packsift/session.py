"""Session construction and the shared folder for cut lineage and job output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Fixed value: Spark's default size of a file split.
SPLIT_BYTES = 128 * 1024 * 1024

# Folders of local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(app_name: str = "packsift", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; ``conf`` overrides any of them."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Where every build partition is small, join by hash instead of sorting content.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(256 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
        # Archives are wide rows: bound Arrow batches by bytes, not only by rows.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(128 * 1024 * 1024),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when the whole session is local.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    key = f"{spark.sparkContext.applicationId}"
    if key not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[key] = tempfile.mkdtemp(prefix="packsift-")
    return _LOCAL_FOLDERS[key]


def output_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one table; all tables of an application share a parent,
    which can be removed when the application is done."""
    return f"{shared_dir(spark)}/packsift/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for heavy work on input too small to have a split per core.

    Decided from the planner's size estimate: only input below one file split per
    core is redistributed, so what moves is bounded; larger input stays in place.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if estimate < cores * SPLIT_BYTES else df


def settle(df: DataFrame, name: str = "settled", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    For narrow rows that several later steps read: the work before is done once,
    every step sees the same rows in the same files, and a lost executor costs a
    re-read instead of a recomputation. ``options`` are those of the writer.
    """
    spark = df.sparkSession
    folder = output_dir(spark, name)
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
