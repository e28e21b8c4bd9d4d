"""Views that feed the operators from the given tables, in Spark and in DuckDB SQL.

files      documents: source is the package, lang the distribution
entries    lineitem: one archive per order
jobs       events: one job per event, error events ask for older rules
cached     labelled documents: content that was scanned in an earlier run
rules      text rules with patterns that mean the same in Java and RE2
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.schemas import RULE

# check_id, pattern, languages, path pattern, message, severity.
_RULES = [
    (
        "corpus.text.email-address",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        ["python"],
        None,
        "Mail address in text.",
        "INFO",
    ),
    (
        "corpus.secrets.hex-token",
        r'token = "[0-9a-f]{40}"',
        ["python", "javascript"],
        None,
        "Token assigned in plain text.",
        "ERROR",
    ),
    (
        "corpus.legal.license-line",
        r"(?i)licensed under|released under|copyright",
        ["javascript"],
        r"\.d/",
        "License wording.",
        "INFO",
    ),
    (
        "corpus.text.phone-number",
        r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
        ["python"],
        r"^(?:en|de)",
        "Phone number in text.",
        "WARNING",
    ),
    (
        "corpus.net.ipv4-address",
        r"(?:^|[^0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:[^0-9.]|$)",
        ["javascript"],
        None,
        "Address literal.",
        "WARNING",
    ),
]

_ARROW_RULE = pa.schema(
    [(field.name, pa.list_(pa.string()) if field.name == "languages" else pa.string()) for field in RULE]
)
EVIDENCE = {"evidence": "one line", "confidence": "medium", "execution_context": "any"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


def as_files(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("source").alias("pkg"),
        F.expr("CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END").alias("dist_index"),
        F.expr(
            "concat(lang, CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '.d/' END, CAST(doc_id AS STRING), "
            "CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.tar.gz' ELSE '' END)"
        ).alias("path"),
        F.col("text").alias("content"),
        "doc_id",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("archive"),
        F.floor("l_extendedprice").cast("bigint").alias("size"),
        F.expr(
            "CASE l_returnflag WHEN 'N' THEN 'stored' WHEN 'R' THEN 'deflated' "
            "ELSE CASE WHEN l_linenumber = 7 THEN 'bzip2' ELSE 'deflated' END END"
        ).alias("method"),
        F.expr(
            "concat(CASE WHEN l_linenumber = 6 AND l_linestatus = 'F' THEN '../' ELSE 'src/' END, "
            "CAST(l_partkey AS STRING), '.py')"
        ).alias("name"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_shipdate",
    )


ENTRY_ORDER = [
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_shipdate",
]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_jobs(table(spark, sf_dir, "events"))


def as_jobs(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("pkg_id"),
        F.when(F.col("event_type") == "error", "rules-old").otherwise("rules-new").alias("hash"),
        "ts",
        "event_type",
        "props",
    )


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled files with their labels; ``content`` as in files."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    return files(spark, sf_dir).join(labels, "doc_id")


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job"), F.col("turn").alias("seq"), F.col("text").alias("warning")
    )


def rules(spark: SparkSession, languages: bool = False, paths: bool = False) -> DataFrame:
    rows = [
        {
            "check_id": check_id,
            "kind": "regex",
            "pattern": pattern,
            "languages": langs if languages else None,
            "path_pattern": path if paths else None,
            "message": message,
            "severity": severity,
            **EVIDENCE,
        }
        for check_id, pattern, langs, path, message, severity in _RULES
    ]
    # From an Arrow table the rules are a local relation: reading them is no job.
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_ARROW_RULE), RULE)


def literal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a literal rule."""
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark."), F.col("item_id").cast("string")).alias("check_id"),
        F.lit("literal").alias("kind"),
        F.col("text").alias("pattern"),
        F.lit(None).cast("array<string>").alias("languages"),
        F.lit(None).cast("string").alias("path_pattern"),
        F.lit("Known passage.").alias("message"),
        F.lit("INFO").alias("severity"),
        *[F.lit(value).alias(name) for name, value in EVIDENCE.items()],
    )


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


# -- the same views for DuckDB -----------------------------------------------------

FILES = """files AS (
  SELECT doc_id, source AS pkg,
    CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS dist_index,
    concat(lang, CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '.d/' END, CAST(doc_id AS VARCHAR),
      CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.tar.gz' ELSE '' END) AS path,
    text AS content
  FROM documents)"""

# index: identity per file, the way the fixture's extensions are known to be.
INDEX = (
    FILES
    + """, named AS (
  SELECT *, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS size,
    CASE WHEN path LIKE '%.py' THEN 'py' WHEN path LIKE '%.js' THEN 'js'
         WHEN path LIKE '%.tar.gz' THEN 'gz' END AS ext
  FROM files),
index AS (
  SELECT *, sha256 || ':' || CAST(size AS VARCHAR) || ':' ||
    CASE WHEN ext IS NULL THEN 'none' ELSE 'ext=' || ext END AS identity
  FROM named)"""
)

RULES = (
    "rules(check_id, pattern, languages, path_pattern, message, severity) AS (VALUES "
    + ", ".join(
        f"({_quoted(c)}, {_quoted(p)}, [{', '.join(_quoted(x) for x in langs)}], {_quoted(path)}, "
        f"{_quoted(m)}, {_quoted(s)})"
        for c, p, langs, path, m, s in _RULES
    )
    + ")"
)

# findings: (identity, check_id, start_line) of every regex rule on every identity.
FINDINGS = (
    INDEX
    + ", "
    + RULES
    + """, targets AS (
  SELECT identity, any_value(sha256) AS sha256, any_value(size) AS size, any_value(ext) AS ext,
    any_value(content) AS content FROM index GROUP BY identity),
lines AS (
  SELECT identity, unnest(string_split(content, chr(10))) AS line,
    unnest(range(1, len(string_split(content, chr(10))) + 1)) AS start_line
  FROM targets),
findings AS (
  SELECT identity, check_id, start_line FROM lines JOIN rules ON regexp_matches(line, pattern))"""
)

CACHED = """labelled AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cached AS (SELECT index.*, quality, toxic FROM index JOIN labelled USING (doc_id))"""

ENTRIES = """entries AS (
  SELECT l_orderkey AS archive, CAST(floor(l_extendedprice) AS BIGINT) AS size,
    CASE l_returnflag WHEN 'N' THEN 'stored' WHEN 'R' THEN 'deflated'
      ELSE CASE WHEN l_linenumber = 7 THEN 'bzip2' ELSE 'deflated' END END AS method,
    concat(CASE WHEN l_linenumber = 6 AND l_linestatus = 'F' THEN '../' ELSE 'src/' END,
      CAST(l_partkey AS VARCHAR), '.py') AS name,
    l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate
  FROM lineitem)"""

JOBS = """jobs AS (
  SELECT event_id AS seq, user_id AS pkg_id,
    CASE WHEN event_type = 'error' THEN 'rules-old' ELSE 'rules-new' END AS hash,
    ts, event_type, props FROM events)"""
