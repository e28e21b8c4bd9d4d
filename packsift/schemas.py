"""Explicit record types; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _B = T.StringType(), T.LongType(), T.BinaryType()

JOB = _struct(
    ("hash", _S),
    ("name", _S),
    ("version", _S),
    ("distributions", T.ArrayType(_S)),
    ("attempt", _L),
    ("assignment_id", _S),
)

SNAPSHOT = _struct(("hash", _S), ("rules", T.MapType(_S, _S)))

RAW_FINDING = _struct(
    ("check_id", _S),
    ("path", _S),
    ("start", _struct(("line", _L))),
    ("end", _struct(("line", _L))),
    (
        "extra",
        _struct(
            ("message", _S),
            ("severity", _S),
            (
                "metadata",
                _struct(("evidence", _S), ("confidence", _S), ("execution_context", _S)),
            ),
        ),
    ),
)

SCAN_DOCUMENT = _struct(
    ("results", T.ArrayType(RAW_FINDING)),
    ("paths", _struct(("scanned", T.ArrayType(_S)))),
    ("errors", T.ArrayType(_S)),
    ("skipped_rules", T.ArrayType(_S)),
)

FINDING = _struct(
    ("rule_id", _S),
    ("path", _S),
    ("start_line", _L),
    ("end_line", _L),
    ("message", _S),
    ("severity", _S),
    ("evidence", _S),
    ("confidence", _S),
    ("execution_context", _S),
    ("inspector_url", _S),
)

# One rule of a snapshot. ``kind`` is 'regex' or 'literal'; NULL languages means
# any file, NULL path_pattern means the rule looks at content alone.
RULE = _struct(
    ("check_id", _S),
    ("kind", _S),
    ("pattern", _S),
    ("languages", T.ArrayType(_S)),
    ("path_pattern", _S),
    ("message", _S),
    ("severity", _S),
    ("evidence", _S),
    ("confidence", _S),
    ("execution_context", _S),
)

ARCHIVE_ENTRY = _struct(
    ("archive", _S),
    ("entry_no", _L),
    ("path", _S),
    ("method", _S),
    ("size", _L),
    ("content", _B),
    ("error", _S),
)

NAMESPACE = ["scanner", "rules_commit", "rules_digest", "engine_digest"]

CACHE_ENTRY = _struct(
    *[(name, _S) for name in NAMESPACE],
    ("file_digest", _S),
    ("language", _S),
    ("result", _S),
)


def required(schema: T.StructType, prefix: str = "") -> Column:
    """True where every leaf of ``schema`` is present.

    JSON parsing turns a missing field into NULL, so presence is a predicate.
    """
    checks = []
    for field in schema.fields:
        name = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            checks.append(required(field.dataType, f"{name}."))
        else:
            checks.append(F.col(name).isNotNull())
    result = checks[0]
    for check in checks[1:]:
        result = result & check
    return result


def required_item(item: Column, schema: T.StructType) -> Column:
    """Like :func:`required`, for a struct-valued column such as an array element."""
    result = item.isNotNull()
    for field in schema.fields:
        value = item[field.name]
        if isinstance(field.dataType, T.StructType):
            result = result & required_item(value, field.dataType)
        else:
            result = result & value.isNotNull()
    return result
