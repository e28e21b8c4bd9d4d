"""Column functions on fixed pairs."""

import json

import pytest
from pyspark.sql import functions as F

from packsift.functions.findings import (
    is_recoverable_warning,
    rule_id,
    truncate_chars,
    warning_text,
)
from packsift.functions.identity import durable_language, identity_key, target_id_of, target_name, with_identity
from packsift.functions.paths import extension, is_safe_path, path_parts, relative_path
from packsift.functions.urls import inspector_base, inspector_url, is_allowed_origin


def evaluate(spark, column, *rows):
    """``column(value)`` for every row, in order."""
    frame = spark.createDataFrame([(n, row) for n, row in enumerate(rows)], "n int, value string")
    return [row[1] for row in frame.select("n", column(F.col("value")).alias("out")).orderBy("n").collect()]


def test_safe_paths(spark):
    rejected = ["", "/", "/etc/x", "..", "../../y", "p/../../y", "p/q/..", ".", "./p"]
    accepted = ["p", "p/q.r", "p//q", "p/./q", "...", "..p/q", "p../q", "p/..q", "..\n"]
    assert evaluate(spark, is_safe_path, *rejected) == [False] * len(rejected)
    assert evaluate(spark, is_safe_path, *accepted) == [True] * len(accepted)


def test_relative_paths(spark):
    paths = evaluate(
        spark,
        lambda p: relative_path(p, F.lit("/work/t")),
        "/work/t/a/b.py",
        "a\\b.py",
        "/work/tx/a",
        "/work/t",
        "../a",
        "..\\a",
        "é" * 513,
        "é" * 512,
    )
    assert [p["path"] for p in paths] == ["a/b.py", "a/b.py", None, None, None, None, None, "é" * 512]
    assert paths[6]["error"] == "path-too-long: more than 1024 bytes"
    assert all(p["error"] for p in paths if p["path"] is None)


@pytest.mark.parametrize(
    "path, expected",
    [(".bashrc", None), ("foo.", ""), ("a.tar.gz", "gz"), ("a/b.PY", "PY"), ("a.b/c", None), ("a.py/", "py"), ("..", None)],
)
def test_extension(spark, path, expected):
    assert evaluate(spark, extension, path) == [expected]


def test_paths_sort_by_component(spark):
    frame = spark.createDataFrame([("a.b",), ("a/b",), ("a",)], "p string")
    assert [r.p for r in frame.orderBy(path_parts(F.col("p"))).collect()] == ["a", "a/b", "a.b"]


# The project page of the same host, with port, query and fragment kept.
PACKAGE_URLS = [
    ("left_pad", "0.9", "https://host.example/left.zip", "https://inspector.pypi.io/project/left_pad/0.9/left.zip/"),
    ("x", "2!1.0", "http://h.example:81/d/e.tgz", "http://inspector.pypi.io:81/project/x/2!1.0/d/e.tgz/"),
    ("x", "1", "https://h.example/d?k=v&w", "https://inspector.pypi.io/project/x/1/d/?k=v&w"),
    ("x", "1", "https://h.example/d#part", "https://inspector.pypi.io/project/x/1/d/#part"),
]


@pytest.mark.parametrize("name, version, url, expected", PACKAGE_URLS)
def test_inspector_base(spark, name, version, url, expected):
    assert evaluate(spark, lambda u: inspector_base(F.lit(name), F.lit(version), u), url) == [expected]


def test_inspector_url_limit_is_in_bytes(spark):
    urls = evaluate(spark, lambda p: inspector_url(F.lit("x"), p), "é" * 1023, "é" * 1024)
    assert urls[0]["url"] == "x" + "é" * 1023
    assert urls[1]["url"] is None and urls[1]["error"]


def test_allowed_origins(spark):
    accepted = ["http://a.test:8080", "HTTP://A.test:8080/", "https://bücher.test", "https://[::1]:443", "https://bücher.test:443//"]
    rejected = [
        None,
        "",
        "a.test:8080",
        "ftp://a.test:8080",
        "http://a.test",
        "http://a.test:80800",
        "http://u:p@a.test:8080",
        "http://a.test:8080/?",
        "http://a.test:8080#",
        "http://a.test:8080/x/..",
        "https://bücher.test.b.test",
        "https://[::2]",
        "https:///bücher.test",
    ]
    check = lambda u: F.coalesce(is_allowed_origin(u, ["http://a.test:8080", "https://bücher.test", "https://[::1]"]), F.lit(False))
    assert evaluate(spark, check, *accepted) == [True] * len(accepted)
    assert evaluate(spark, check, *rejected) == [False] * len(rejected)


def test_warnings(spark):
    records = [
        {"level": "warn", "type": "Timeout"},
        {"level": "warn", "type": "Timeout", "rule_id": "a.b." + "r" * 300},
        {"level": "warn", "type": ["PartialParsing", []], "path": "q/w/lib.pyi"},
        {"level": "warn", "type": ["PartialParsing", []]},
        {"level": "error", "type": "Timeout"},
        {"level": "warn", "type": ["Other"]},
        {"type": "Timeout"},
    ]
    texts = [json.dumps(record) for record in records]
    assert evaluate(spark, is_recoverable_warning, *texts) == [True] * 4 + [False] * 3
    assert evaluate(spark, warning_text, *texts[:4]) == [
        "timeout: some rule",
        "timeout: " + "r" * 200,
        "partly-parsed: lib.pyi",
        "partly-parsed: unnamed file",
    ]


def test_rule_id_and_truncation(spark):
    assert evaluate(spark, rule_id, "a.b.c", "plain") == ["c", "plain"]
    assert evaluate(spark, lambda v: truncate_chars(v, 2), "é😀x") == ["é😀"]


def test_identity(spark):
    frame = spark.createDataFrame([("q/lib.pyi", "x = 1\n"), ("é", "é")], "path string, content string")
    rows = {r.path: r for r in with_identity(frame).collect()}
    assert rows["q/lib.pyi"].size == 6 and rows["q/lib.pyi"].ext == "pyi"
    assert rows["é"].size == 2 and rows["é"].ext is None


def test_missing_and_empty_extension(spark):
    frame = spark.createDataFrame([(None,), ("",), ("x" * 33,)], "ext string")
    keys = frame.select(identity_key(F.lit("d"), F.lit(1), F.col("ext")), durable_language(F.col("ext"))).collect()
    assert keys[0][0] != keys[1][0]
    assert [k[1] for k in keys] == ["", "", None]


def test_target_names(spark):
    frame = spark.createDataFrame([(1, "py"), (255, None), (2**40, "")], "id bigint, ext string")
    names = frame.select("id", target_name(F.col("id"), F.col("ext")).alias("name"))
    rows = names.withColumn("back", target_id_of(F.col("name"))).collect()
    assert [r.name for r in rows] == ["0000000000000001.py", "00000000000000ff", "0000010000000000"]
    assert all(r.id == r.back for r in rows)
