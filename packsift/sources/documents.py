"""Matcher output documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packsift.functions.findings import is_recoverable_warning, warning_text
from packsift.schemas import RAW_FINDING, SCAN_DOCUMENT, required_item


def parse_documents(rows: DataFrame, column: str = "document") -> DataFrame:
    """Add results, scanned, errors, skipped_rules and failure.

    Results are required and complete; the other lists default to empty. Errors
    other than recoverable warnings, and any skipped rule, fail the document.
    """
    empty = F.array().cast(T.ArrayType(T.StringType()))
    parsed = F.from_json(column, SCAN_DOCUMENT)
    rows = rows.withColumn("_d", parsed).drop(column)
    out = rows.select(
        *[c for c in rows.columns if c != "_d"],
        F.col("_d.results").alias("results"),
        F.coalesce(F.col("_d.paths.scanned"), empty).alias("scanned"),
        F.coalesce(F.col("_d.errors"), empty).alias("errors"),
        F.coalesce(F.col("_d.skipped_rules"), empty).alias("skipped_rules"),
    )
    complete = F.forall("results", lambda item: required_item(item, RAW_FINDING))
    unexpected = F.filter("errors", lambda e: ~is_recoverable_warning(e))
    failure = (
        F.when(~F.coalesce(complete, F.lit(False)), F.lit("document-unreadable: results are missing or malformed"))
        .when(
            F.size(unexpected) > 0,
            F.concat(F.lit("document-errors: "), _json_list(unexpected)),
        )
        .when(skipped(F.col("skipped_rules")), F.concat(F.lit("document-skipped: "), _json_list(F.col("skipped_rules"))))
    )
    return out.withColumn("failure", failure)


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def skipped(skipped_rules: Column) -> Column:
    return F.size(skipped_rules) > 0


def warnings(errors: Column) -> Column:
    """Texts of the recoverable warnings, in document order."""
    return F.transform(F.filter(errors, is_recoverable_warning), warning_text)


def raw_findings(documents: DataFrame, key: list[str]) -> DataFrame:
    """One row per raw finding of the documents that did not fail."""
    return documents.where("failure IS NULL").select(*key, F.posexplode("results").alias("finding_no", "raw"))
