"""Jobs from archive blobs to reports."""

import json

from pyspark.sql import functions as F

from packsift.operators.reports import job_reports
from packsift.schemas import JOB
from packsift.settings import ArchiveLimits
from packsift.sources.archives import package_files
from packsift.sources.jobs import fetch_archives, job_distributions, split_by_rules
from tests.test_operators import make_tar, make_zip, rule, rules


def test_reports_from_archives(spark):
    whl, tar, bad, big = (f"https://files.example.org/{n}" for n in ("a.whl", "b.tar.gz", "c.whl", "d.whl"))
    jobs = spark.createDataFrame(
        [
            ("new", "good", "1", [whl, tar], 1, "lease-1"),
            ("new", "clean", "2", [], 1, "lease-2"),
            ("new", "broken", "3", [whl, bad], 1, "lease-3"),
            ("new", "huge", "4", [big], 1, "lease-4"),
            ("new", "many", "5", [whl] * 4, 1, "lease-5"),
            ("old", "late", "6", [whl], 1, "lease-6"),
        ],
        JOB,
    ).withColumn("pkg", F.col("assignment_id"))
    blobs = {
        whl: make_zip([("x.py", b"exec('a')\n"), ("bin", b"\xff exec('b')")]),
        tar: make_tar([("d/y.py", b"#\nexec('a')\n"), ("z.py", b"exec('a')\n")]),
        bad: make_zip([("../x.py", b"1")]),
        big: b"0" * 5000,
    }
    stored = spark.createDataFrame(
        [(u, len(b), bytearray(b)) for u, b in blobs.items()], "url string, length bigint, content binary"
    )
    ready, deferred = split_by_rules(jobs, spark.createDataFrame([("new",)], "hash string"))
    assert [r.name for r in deferred.collect()] == ["late"]
    fetched = fetch_archives(job_distributions(ready), stored, limit=4000)
    files, failures = package_files(fetched, ArchiveLimits())
    warnings = spark.createDataFrame([("lease-2", 1, "late"), ("lease-2", 2, "later")], "pkg string, seq int, text string")
    corpus = rules(spark, rule("a.exec", r"exec\("))
    rows = {
        r.pkg: r for r in job_reports(ready, files, corpus, failures, warnings, max_distributions=3).collect()
    }
    assert {k: r.status for k, r in rows.items()} == {
        "lease-1": "success",
        "lease-2": "success",
        "lease-3": "error",
        "lease-4": "error",
        "lease-5": "error",
    }
    good = json.loads(rows["lease-1"].report)
    assert good["commit"] == "new" and "reason" not in good and "partial_reason" not in good
    assert [(f["path"], f["start_line"], f["rule_id"]) for f in good["findings"]] == [
        ("bin", 1, "exec"),
        ("d/y.py", 2, "exec"),
        ("x.py", 1, "exec"),
        ("z.py", 1, "exec"),
    ]
    assert good["findings"][1]["inspector_url"] == "https://inspector.pypi.io/project/good/1/b.tar.gz/d/y.py"
    clean = json.loads(rows["lease-2"].report)
    assert clean["findings"] == [] and clean["partial_reason"] == "late; later"
    broken = json.loads(rows["lease-3"].report)
    assert broken["reason"].startswith("unsafe-name") and "findings" not in broken
    assert json.loads(rows["lease-4"].report)["reason"].startswith("blob-too-large")
    assert json.loads(rows["lease-5"].report)["reason"] == "too-many-distributions: 4 of 3"
    capped = job_reports(ready, files, corpus, failures, warnings, max_findings=3).where("pkg = 'lease-1'").first()
    assert capped.status == "error" and "too-many-findings: more than 3" in capped.report
