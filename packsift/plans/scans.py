"""Rule scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.operators.rule_index import scan_indexed
from packsift.operators.scan import is_scanned, scan_literal, scan_regex
from packsift.plans.catalog import query
from packsift.plans.corpus import Corpus
from packsift.plans.sources import DOCUMENTS, matcher_documents
from packsift.plans.views import FINDINGS, literal_rules, rules, table
from packsift.sources.documents import parse_documents, skipped


@query(
    "scan_rules_regex",
    f"WITH {FINDINGS} SELECT identity, check_id, start_line, start_line AS end_line FROM findings",
)
def scan_rules_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_regex(Corpus(spark, sf_dir).targets, rules(spark), ["identity"])


@query(
    "scan_rules_index",
    f"""WITH {FINDINGS}, r AS (
  SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '(?i)' ELSE '' END || regexp_replace(upper(substr(text, 1, 1)) || substr(text, 2, 23), '[^A-Za-z ]', '.', 'g')
    || CASE WHEN item_id % 5 = 0 THEN '|copyright [0-9]+|[^ ]+@[^ ]+' ELSE '' END AS pattern FROM benchmark)
SELECT identity, 'passage.' || item_id AS check_id, start_line, start_line AS end_line FROM lines JOIN r ON regexp_matches(line, r.pattern)""",
)
def scan_rules_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regex rule for the beginning of every benchmark passage, some with alternatives, one
    of which has no text to look up."""
    text = F.concat(F.upper(F.substring("text", 1, 1)), F.substring("text", 2, 23))
    pattern = F.concat(
        F.when(F.col("item_id") % 3 == 0, "(?i)").otherwise(""),
        F.regexp_replace(text, "[^A-Za-z ]", "."),
        F.when(F.col("item_id") % 5 == 0, "|copyright [0-9]+|[^ ]+@[^ ]+").otherwise(""),
    )
    rows = literal_rules(spark, sf_dir).drop("check_id", "pattern", "kind")
    passages = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("passage."), F.col("item_id").cast("string")).alias("check_id"), F.lit("regex").alias("kind"), pattern.alias("pattern")
    )
    columns = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return scan_indexed(Corpus(spark, sf_dir).targets, passages.select("*", *columns), ["identity"])


@query(
    "scan_rules_literal",
    f"""WITH {FINDINGS}, hits AS (
  SELECT identity, 'benchmark.' || item_id AS check_id, string_split(content, chr(10)) AS lines, string_split(text, chr(10)) AS parts
  FROM targets JOIN benchmark ON contains(content, text)),
placed AS (SELECT *, unnest(range(1, len(lines) + 1)) AS start_line FROM hits)
SELECT identity, check_id, start_line, start_line + len(parts) - 1 AS end_line FROM placed
WHERE CASE WHEN len(parts) = 1 THEN contains(lines[start_line], parts[1]) ELSE ends_with(lines[start_line], parts[1])
  AND starts_with(array_to_string(list_slice(lines, start_line + 1, start_line + len(parts) - 1), chr(10)),
    array_to_string(list_slice(parts, 2, len(parts)), chr(10))) END""",
)
def scan_rules_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_literal(Corpus(spark, sf_dir).targets, literal_rules(spark, sf_dir), ["identity"])


@query(
    "scan_rule_applicability",
    f"WITH {FINDINGS} SELECT identity, coalesce(ext IN ('py', 'pyi', 'js', 'jsx', 'mjs', 'cjs'), FALSE) AS scanned FROM targets",
)
def scan_rule_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = Corpus(spark, sf_dir).identities
    return every.select("identity", is_scanned(rules(spark, languages=True)).alias("scanned"))


@query(
    "scan_skipped_rules",
    f"WITH {DOCUMENTS} SELECT conv_id, turn, NOT bare AND turn = 4 AS skipped FROM docs",
)
def scan_skipped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_documents(matcher_documents(spark, sf_dir))
    return parsed.select("conv_id", "turn", skipped(F.col("skipped_rules")).alias("skipped"))
