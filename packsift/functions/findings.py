"""Matcher output: rule names, warnings and normalised findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsift.functions.binding import let
from packsift.functions.paths import relative_path
from packsift.functions.urls import inspector_url
from packsift.settings import MAX_BASENAME_CHARS, MAX_MESSAGE_BYTES, MAX_RULE_ID_CHARS


def truncate_chars(text: Column, limit: int) -> Column:
    """First ``limit`` characters (code points); byte limits are separate checks."""
    return F.substring(text, 1, limit)


def rule_id(check_id: Column) -> Column:
    return F.substring_index(check_id, ".", -1)


def _field(record: Column, path: str) -> Column:
    """A field of a VARIANT as text, NULL where it is missing."""
    return F.try_variant_get(record, path, "string")


def is_recoverable_warning(error_json: Column) -> Column:
    """Warnings that keep the other findings valid: timeouts and partial parses.

    ``type`` is a text or an array that begins with one, so the record is read as a VARIANT,
    once. What is no JSON is no warning.
    """

    def recoverable(record: Column) -> Column:
        timeout = _field(record, "$.type") == "Timeout"
        partial = _field(record, "$.type[0]") == "PartialParsing"
        return (_field(record, "$.level") == "warn") & (F.coalesce(timeout, F.lit(False)) | F.coalesce(partial, F.lit(False)))

    return F.coalesce(let(F.try_parse_json(error_json), recoverable), F.lit(False))


def warning_text(error_json: Column) -> Column:
    """Readable form of a recoverable warning."""

    def text(record: Column) -> Column:
        rule, path = _field(record, "$.rule_id"), _field(record, "$.path")
        timeout = F.when(rule.isNull(), F.lit("timeout: some rule")).otherwise(
            F.concat(F.lit("timeout: "), truncate_chars(rule_id(rule), MAX_RULE_ID_CHARS))
        )
        target = F.coalesce(F.substring_index(path, "/", -1), F.lit("unnamed file"))
        partial = F.concat(F.lit("partly-parsed: "), truncate_chars(target, MAX_BASENAME_CHARS))
        return F.when(_field(record, "$.type") == "Timeout", timeout).otherwise(partial)

    return let(F.try_parse_json(error_json), text)


def normalize_finding(raw: Column, root: Column, base: Column) -> Column:
    """Struct ``(finding, error)`` from one nested matcher result."""
    message = raw["extra"]["message"]
    metadata = raw["extra"]["metadata"]

    def finding(located: Column, link: Column) -> Column:
        error = F.coalesce(
            located["error"],
            F.when(F.octet_length(message) > MAX_MESSAGE_BYTES, F.lit(f"message-too-long: more than {MAX_MESSAGE_BYTES} bytes")),
            link["error"],
        )
        fields = F.struct(
            rule_id(raw["check_id"]).alias("rule_id"),
            located["path"].alias("path"),
            raw["start"]["line"].alias("start_line"),
            raw["end"]["line"].alias("end_line"),
            message.alias("message"),
            raw["extra"]["severity"].alias("severity"),
            metadata["evidence"].alias("evidence"),
            metadata["confidence"].alias("confidence"),
            metadata["execution_context"].alias("execution_context"),
            link["url"].alias("inspector_url"),
        )
        return F.struct(F.when(error.isNull(), fields).alias("finding"), error.alias("error"))

    return let(
        relative_path(raw["path"], root),
        lambda located: let(inspector_url(base, located["path"]), lambda link: finding(located, link)),
    )
