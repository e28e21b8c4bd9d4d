"""Operators on small fixtures and against brute force."""

import hashlib
import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from packsift.operators.admission import until_first_timeout
from packsift.operators.dedup import file_index, package_counts, target_ids, write_manifest
from packsift.operators.digest import engine_digest, rules_digest
from packsift.operators.expand import (
    findings_per_group,
    gather_findings,
    scan_by_distribution,
    scan_corpus,
    scan_package,
)
from packsift.operators.outcome import partial_reasons
from packsift.operators.reuse import admit, audit_hits, decide, fifo_retention, lookup, mismatched_keys, new_entries
from packsift.operators.running import running_totals
from packsift.operators.runs import apply
from packsift.operators.scan import (
    rule_batches,
    rules_reusable,
    scan,
    scan_literal,
    scan_regex,
    scanned_targets,
)
from packsift.operators.skew import skew_safe_join
from packsift.plans import views
from packsift.schemas import JOB, RULE
from packsift.settings import ArchiveLimits
from packsift.sources.archives import expand_archives
from packsift.sources.content_store import stored_files
from packsift.sources.documents import parse_documents, raw_findings, warnings
from packsift.sources.files import walk
from packsift.sources.jobs import complete_jobs, explode_rules, fetch_archives, lease, read_archive_files, read_jobs, read_snapshot

FILES = "pkg string, dist_index int, path string, content string"
TWIN = "import twin\n"


def rule(check_id, pattern, kind="regex", languages=None, path=None):
    return (check_id, kind, pattern, languages, path, "m", "ERROR", "one line", "medium", "any")


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), RULE)


def plain(rows):
    return sorted(tuple(row) for row in rows)


# -- running totals and salted joins ---------------------------------------------------


def test_running_totals_match_a_sequential_sum(spark):
    random.seed(3)
    # One group holds most rows, so it spans several blocks.
    rows = [("hot" if n % 10 else f"g{n % 70}", n, random.randint(0, 9)) for n in range(4000)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, o int, v int").repartition(6)
    got = running_totals(frame, ["g"], [F.col("o")], {"n": F.lit(1), "total": F.col("v")}).collect()
    expected, sums = {}, {}
    for g, o, v in sorted(rows):
        n, total = sums.get(g, (0, 0))
        sums[g] = expected[g, o] = (n + 1, total + v)
    assert {(r.g, r.o): (r.n, r.total) for r in got} == expected


def test_running_totals_descending_over_everything(spark):
    frame = spark.range(3000).select(F.col("id").alias("o"))
    got = running_totals(frame, [], [F.col("o").desc()], {"n": F.lit(1)}).collect()
    assert all(r.n == 3000 - r.o for r in got) and len(got) == 3000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    facts = spark.range(2000).select(
        F.when(F.col("id") % 3 != 0, F.lit(None).cast("string")).otherwise(F.lit("hot")).alias("k0"), "id"
    )
    facts = facts.select(F.coalesce("k0", (F.col("id") % 50).cast("string")).alias("k"), "id")
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("none", 4)], "k string, v int")
    salted = skew_safe_join(facts, side, ["k"], how, rows_per_salt=20)
    expected = facts.join(side, ["k"], how)
    assert plain(salted.select(*expected.columns).collect()) == plain(expected.collect())


# -- deduplication ---------------------------------------------------------------------


def alias_files(spark):
    rows = [
        ("lib", 0, "z/core.pyi", TWIN),
        ("lib", 0, "z/again/core.pyi", TWIN),
        ("lib", 0, "notes", TWIN),
        ("lib", 2, "core.pyi", TWIN),
        ("lib", 2, "core.mjs", TWIN),
        ("lib", 2, "alone.mjs", "let alone\n"),
    ]
    return spark.createDataFrame(rows, FILES)


def test_aliases_of_one_content(spark):
    index = write_manifest(file_index(alias_files(spark)))
    counts = package_counts(index).first()
    assert (counts.aliases, counts.unique_targets, counts.deduplicated) == (6, 4, 2)
    ids = {r.path: r.target_id for r in target_ids(index).collect()}
    assert ids == {"notes": 0, "z/again/core.pyi": 1, "z/core.pyi": 1, "core.pyi": 1, "alone.mjs": 2, "core.mjs": 3}
    found = scan_package(alias_files(spark), rules(spark, rule("a.b", "twin", languages=["python"])))
    assert {r.path for r in found.collect()} == {"z/core.pyi", "z/again/core.pyi", "core.pyi"}


def test_two_distributions_share_one_target(spark):
    rows = [("lib", 0, "up.py", "eval(up)\n"), ("lib", 3, "down/up.py", "eval(up)\n")]
    files = spark.createDataFrame(rows, FILES)
    assert package_counts(file_index(files)).first().unique_targets == 1
    found = scan_package(files, rules(spark, rule("x.eval", r"eval\(")))
    assert {r.path for r in found.collect()} == {"up.py", "down/up.py"}


def test_package_scan_equals_scan_by_distribution(spark, sf_dir):
    files = views.files(spark, sf_dir).drop("doc_id")
    corpus = views.rules(spark, languages=True)
    assert plain(scan_package(files, corpus).collect()) == plain(scan_by_distribution(files, corpus).collect())


def test_path_scoped_rules_are_not_deduplicated(spark):
    files = alias_files(spark)
    scoped = rules(spark, rule("x.twin", "twin", path="^z/again/"))
    properties = spark.createDataFrame(
        [("^z/again/", None, None, None, "SAST", "search")],
        "paths string, options string, dependency_formula string, validators string, product string, mode string",
    )
    assert [r.path for r in scan_corpus(files, scoped, properties).collect()] == ["z/again/core.pyi"]


# -- scans -----------------------------------------------------------------------------


def test_regex_findings_match_line_by_line_search(spark):
    import re

    patterns = {"a": r"^x", "b": r"y$", "c": r"(?i)FOO", "d": r"a\.b+", "e": r"\Aq"}
    texts = ["x\ny\nxy", "foo\n\nq foo", "a.bb\r\nx\r", "q\nq", "", "a.b"]
    targets = spark.createDataFrame([(str(n), None, t) for n, t in enumerate(texts)], "identity string, ext string, content string")
    found = scan_regex(targets, rules(spark, *[rule(k, p) for k, p in patterns.items()]), ["identity"])
    expected = [
        (str(n), k, line_no, line_no)
        for n, text in enumerate(texts)
        for line_no, line in enumerate(text.split("\n"), 1)
        for k, p in patterns.items()
        if re.search(p, line)
    ]
    assert plain(found.select("identity", "check_id", "start_line", "end_line").collect()) == sorted(expected)


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_literal_findings_match_brute_force(spark, broadcast_rows):
    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "é", "x1"]
    separators = [" ", ", ", "\n", "-"]

    def text(length):
        return "".join(random.choice(words) + random.choice(separators) for _ in range(length))

    texts = [text(60) for _ in range(40)] + ["", "alpha"]
    passages = [random.choice(texts)[5:5 + size] for size in (3, 9, 20, 40, 60) for _ in range(6)]
    passages = sorted({p for p in passages if p})
    targets = spark.createDataFrame([(str(n), None, t) for n, t in enumerate(texts)], "identity string, ext string, content string")
    corpus = rules(spark, *[rule(f"r{n}", p, kind="literal") for n, p in enumerate(passages)])
    found = scan_literal(targets, corpus, ["identity"], broadcast_rows=broadcast_rows)
    expected = set()
    for n, t in enumerate(texts):
        for m, p in enumerate(passages):
            at = t.find(p)
            while at >= 0:
                start = t[:at].count("\n") + 1
                expected.add((str(n), f"r{m}", start, start + p.count("\n")))
                at = t.find(p, at + 1)
    assert plain(found.collect()) == sorted(expected)


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_literal_rules_keep_their_scope_and_every_line(spark, broadcast_rows):
    long = "one two three four five six seven"
    targets = spark.createDataFrame(
        [("p", "py", "lib/x", f"{long}\n\n{long}"), ("j", "js", "src/x", long), ("n", None, "src/y", "foo\nfoo\nfoo")],
        "identity string, ext string, path string, content string",
    )
    corpus = rules(
        spark,
        rule("py", long, "literal", languages=["python"]),
        rule("src", long, "literal", path="^src/"),
        rule("two", "foo", "literal"),
        rule("two", long, "literal", languages=["js"]),
        rule("span", f"{long}\n\none", "literal"),
    )
    found = scan_literal(targets, corpus, ["identity"], broadcast_rows=broadcast_rows)
    assert plain(found.collect()) == sorted(
        [("p", "py", 1, 1), ("p", "py", 3, 3), ("j", "src", 1, 1), ("j", "two", 1, 1), ("p", "span", 1, 3)]
        + [("n", "two", line, line) for line in (1, 2, 3)]
    )


def test_rules_of_an_unknown_kind_fail_the_scan(spark):
    targets = spark.createDataFrame([("t", None, "x")], "identity string, ext string, content string")
    with pytest.raises(ValueError, match="odd"):
        scan(targets, rules(spark, rule("odd", "x", kind="taint")), ["identity"])


def test_rules_are_read_in_bounded_batches(spark):
    corpus = rules(spark, *[rule(f"r{n}", f"w{n}x") for n in range(40)])
    batches = list(rule_batches(corpus, max_rows=8))
    assert len(batches) > 1 and sum(len(b) for b in batches) == 40
    targets = spark.createDataFrame([("t", None, "w3x w39x\nw4x")], "identity string, ext string, content string")
    assert {r.check_id for r in scan(targets, corpus, ["identity"]).collect()} == {"r3", "r39", "r4"}


def test_patterns_that_look_past_a_line_are_found_on_each_line(spark):
    texts = {"ahead": (r"foo(?!\s)", "foo\nbar", 1), "vertical": (r"ab\vcd", "ab\x0ccd", 1), "greedy": (r"[^x]*+y", "y\nzx", 1)}
    for name, (pattern, text, line) in texts.items():
        targets = spark.createDataFrame([(name, None, text)], "identity string, ext string, content string")
        assert [(r.start_line) for r in scan(targets, rules(spark, rule(name, pattern)), ["identity"]).collect()] == ([line] if name != "greedy" else [])


def test_unsupported_targets_are_not_scanned(spark):
    targets = spark.createDataFrame([("py",), ("unknown",), (None,)], "ext string")
    assert [r.ext for r in scanned_targets(targets, rules(spark, rule("a", "x", languages=["python"]))).collect()] == ["py"]
    assert scanned_targets(targets, rules(spark, rule("a", "x"))).count() == 3


def test_reusable_rule_corpora(spark):
    schema = "s string, paths string, options string, dependency_formula string, validators string, product string, mode string"
    rows = [
        ("content", None, None, None, None, "SAST", "taint"),
        ("scoped", "src/**", None, None, None, "SAST", "search"),
        ("interfile", None, "interfile", None, None, "SAST", "search"),
        ("mode", None, None, None, None, "SAST", "join"),
    ]
    got = {r.s: r.reusable for r in rules_reusable(spark.createDataFrame(rows, schema), ["s"]).collect()}
    assert got == {"content": True, "scoped": False, "interfile": False, "mode": False}
    assert rules_reusable(spark.createDataFrame([], schema)).first().reusable is False


# -- caps and outcomes -----------------------------------------------------------------


def test_findings_cap_is_an_error(spark):
    rows = spark.range(503).select(F.when(F.col("id") < 500, "ok").otherwise("small").alias("job"), F.col("id").alias("line"))
    assert not any(r.over_limit for r in findings_per_group(rows, ["job"]).collect())
    over = rows.withColumn("job", F.lit("ok"))
    assert findings_per_group(over, ["job"]).first().over_limit
    lists = gather_findings(over, ["job"], ["line"]).first()
    assert lists.over_limit and lists["items"] is None
    assert len(gather_findings(over, ["job"], ["line"], limit=None).first()["items"]) == 503
    exact = gather_findings(rows.where("job = 'ok'"), ["job"], ["line"]).first()
    assert len(exact["items"]) == 500 and not exact.over_limit


def test_partial_reason_is_ordered_and_cut(spark):
    rows = [("a", n, f"warning {n}") for n in range(400)] + [("b", 1, ""), ("b", 2, "x")]
    frame = spark.createDataFrame(rows, "job string, seq int, text string").repartition(4)
    got = {r.job: r.partial_reason for r in partial_reasons(frame, "job", [F.col("seq")], "text").collect()}
    assert got == {"a": "; ".join(f"warning {n}" for n in range(400))[:2048], "b": "; x"}


def test_first_timeout_stops_the_rest(spark):
    rows = [("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, True), ("c", 0, False)]
    frame = spark.createDataFrame(rows, "job string, i int, late boolean")
    assert plain(until_first_timeout(frame, ["job"], "i", F.col("late")).select("job", "i").collect()) == [("a", 0), ("c", 0)]


def test_rules_digest_separates_names_from_contents(spark):
    frame = spark.createDataFrame([(1, "a", "bc"), (2, "ab", "c"), (3, "b", "2"), (3, "a", "1")], "s int, name string, contents string")
    got = {r.s: r.digest for r in rules_digest(frame, ["s"]).collect()}
    assert got[1] != got[2]
    data = b"".join(len(v).to_bytes(8, "big") + v for v in (b"a", b"1", b"b", b"2"))
    assert got[3] == hashlib.sha256(data).hexdigest()


def test_digests_of_many_parts_are_linear(spark):
    blobs = spark.range(100_000).select("id", F.col("id").cast("string").cast("binary").alias("content"))
    whole = b"".join(hashlib.sha256(str(n).encode()).digest() for n in range(100_000))
    assert engine_digest(blobs, "id", tag="t").first().digest == hashlib.sha256(whole + b"t").hexdigest()


# -- reuse -----------------------------------------------------------------------------


def test_every_hundredth_hit_is_audited(spark):
    hits = spark.range(101).select(F.lit("n").alias("ns"), F.col("id").alias("seq"))
    reused = [r.reused for r in audit_hits(hits, ["ns"], [F.col("seq")]).orderBy("seq").collect()]
    assert reused == [True] * 99 + [False, True]


def test_modes(spark):
    targets = spark.createDataFrame([(1, "[]"), (2, None)], "id int, result string")
    for mode, lookups, candidates, reused in (("off", 0, 0, 0), ("observe", 2, 1, 0), ("reuse", 2, 1, 1)):
        rows = decide(targets, mode, [F.col("id")]).collect()
        assert (sum(r.lookups for r in rows), sum(r.candidate for r in rows), sum(r.reused for r in rows)) == (
            lookups,
            candidates,
            reused,
        )
    with pytest.raises(ValueError):
        decide(targets, "other", [])


def test_retention_matches_a_sequential_cache(spark):
    random.seed(11)
    entries = [(n, random.randint(0, 40)) for n in range(300)]
    for max_entries, max_bytes in ((5, 60), (50, 30), (1, 1000), (300, 10_000)):
        held: list[tuple[int, int]] = []
        for seq, size in entries:
            if size > max_bytes:
                continue
            while held and (len(held) >= max_entries or sum(s for _, s in held) + size > max_bytes):
                held.pop(0)
            held.append((seq, size))
        frame = spark.createDataFrame([("g", *e) for e in entries], "g string, seq int, size int")
        got = fifo_retention(frame, ["g"], "seq", "size", max_entries, max_bytes)
        assert {r.seq for r in got.where("retained").collect()} == {seq for seq, _ in held}


def test_multisets_count_repeats(spark):
    old = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "a")], "k string, f string")
    new = spark.createDataFrame([("t", "a"), ("u", "a")], "k string, f string")
    assert [r.k for r in mismatched_keys(old, new, ["k"], ["f"]).collect()] == ["t"]


def run_inputs(spark, contents, pkg="test"):
    files = spark.createDataFrame([(pkg, 0, f"{n}.py", c) for n, c in enumerate(contents)], FILES)
    store, index = stored_files(files)
    return store, index, rules(spark, rule("x.eval", r"eval\("))


def test_poisoned_cache(spark):
    """Two files with findings stored as clean: reusing one fails the job."""
    store, index, corpus = run_inputs(spark, ["eval(a)\n", "b = eval(b)\n"])
    known = index.select("identity").distinct()
    stored = spark.createDataFrame([], "identity string, check_id string, start_line bigint, end_line bigint")
    findings, jobs = apply(store, index, corpus, known, stored, every=2)
    job = jobs.first()
    assert job.failed and job.reused_files == 1 and findings.isEmpty()


def test_honest_cache_is_reused(spark):
    store, index, corpus = run_inputs(spark, ["eval(a)\n", "c = 3\n"])
    known = index.select("identity").distinct()
    stored = scan(store.targets(), corpus, ["identity"])
    findings, jobs = apply(store, index, corpus, known, stored)
    job = jobs.first()
    assert (job.reused_files, job.engine_files, job.failed) == (2, 0, False)
    assert [(r.path, r.check_id) for r in findings.collect()] == [("0.py", "x.eval")]


def test_incomplete_jobs_admit_nothing(spark):
    results = spark.createDataFrame(
        [("whole", "d1", "py", "[]"), ("partial", "d2", "py", "[]"), ("whole", "d3", "py", "x" * 16385), ("whole", "d4", "py", "[]")],
        "pkg string, file_digest string, language string, result string",
    )
    warned = spark.createDataFrame([("partial",)], "pkg string")
    cache = spark.createDataFrame([("d4", "py")], "file_digest string, language string")
    assert [r.file_digest for r in admit(results, warned, cache, ["pkg"]).collect()] == ["d1"]


def test_lookup_and_append(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    cache = spark.createDataFrame([("a", "[1]")], "k string, result string")
    assert plain(lookup(keys, cache, ["k"]).where("result IS NOT NULL").collect()) == [("a", "[1]")]
    fresh = spark.createDataFrame([("a", 1), ("c", 3), ("c", 2)], "k string, seq int")
    assert plain(new_entries(fresh, cache, ["seq"], ["k"]).collect()) == [("c", 2)]


# -- sources ---------------------------------------------------------------------------


def make_zip(files):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, content in files:
            archive.writestr(name, content)
    return buffer.getvalue()


def make_tar(files):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        for name, content in files:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    return buffer.getvalue()


@pytest.mark.parametrize("fmt, make", [("zip", make_zip), ("tar.gz", make_tar)])
def test_archive_limits(spark, fmt, make):
    blobs = {
        "good": make([("pkg/m.py", b"abcdefgh"), ("pkg/sub/n.py", b"ij"), ("r", b"")]),
        "many": make([(f"f{n}", b"") for n in range(4)]),
        "large": make([("big.bin", b"x" * 10)]),
        "expanded": make([(f"f{n}", b"y" * 8) for n in range(3)]),
        "escape": make([("pkg/../../out", b"z")]),
        "rooted": make([("/out", b"z")]) if fmt == "zip" else make([("a/../../out", b"z")]),
        "broken": b"\x00\x01 no archive at all",
        "cut": make([("pkg/m.py", bytes(range(200)) * 9)])[:-40],
    }
    frame = spark.createDataFrame([(k, bytearray(v), fmt) for k, v in blobs.items()], "archive string, content binary, format string")
    limits = ArchiveLimits(entries=3, download_size=8192, expanded_size=20, scan_size=9)
    rows = expand_archives(frame, limits).collect()
    good = [(r.path, bytes(r.content), r.size, r.error) for r in rows if r.archive == "good"]
    assert good == [("pkg/m.py", b"abcdefgh", 8, None), ("pkg/sub/n.py", b"ij", 2, None), ("r", b"", 0, None)]
    errors = {r.archive: r.error for r in rows if r.archive != "good"}
    assert set(errors) == set(blobs) - {"good"} and all(errors.values())
    codes = {name: error.split(":")[0] for name, error in errors.items()}
    assert codes["many"] == "too-many-entries" and codes["large"] == "entry-too-large" and codes["expanded"] == "expands-too-far"
    assert codes["escape"] == codes["rooted"] == "unsafe-name"
    small = expand_archives(frame.where("archive = 'good'"), ArchiveLimits(download_size=4)).first()
    assert small.error == "blob-too-large: more than 4 bytes"


def test_damaged_encrypted_and_repeated_entries_are_errors_of_their_archive(spark):
    twice = [("m.py", b"clean"), ("m.py", b"exec(1)")]
    with pytest.warns(UserWarning):
        repeated = make_zip(twice)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("m.py", b"abc" * 200)
    damaged = bytearray(buffer.getvalue())
    damaged[36:46] = b"\xff" * 10  # within the deflated data
    encrypted = bytearray(make_zip([("m.py", b"abc")]))
    for at in (6, encrypted.index(b"PK\x01\x02") + 8):  # the flag in both headers
        encrypted[at] |= 1
    blobs = [("repeated", repeated), ("damaged", damaged), ("encrypted", encrypted), ("good", make_zip([("n.py", b"1")])), ("none", None)]
    frame = spark.createDataFrame([(k, bytearray(v) if v else None, "zip") for k, v in blobs], "archive string, content binary, format string")
    rows = {r.archive: r for r in expand_archives(frame).collect()}
    assert rows["good"].error is None and bytes(rows["good"].content) == b"1"
    assert {k: r.error.split(":")[0] for k, r in rows.items() if k != "good"} == {
        "repeated": "repeated-name", "damaged": "not-readable", "encrypted": "not-readable", "none": "blob-missing"
    }
    tar = spark.createDataFrame([("t", bytearray(make_tar(twice)), "tar.gz")], "archive string, content binary, format string")
    assert [(r.path, bytes(r.content)) for r in expand_archives(tar).collect()] == [("m.py", b"exec(1)")]


def test_missing_and_oversized_blobs_fail_their_distribution(spark, tmp_path):
    wanted = spark.createDataFrame([("p", 0, "u1"), ("p", 1, "gone"), ("q", 0, "big.tar.gz")], "pkg string, dist_index int, url string")
    blobs = spark.createDataFrame([("u1", 3, bytearray(b"abc")), ("big.tar.gz", 99, bytearray(b"x" * 99))], "url string, length bigint, content binary")
    got = {r.url: (r.content is not None, (r.error or "").split(":")[0]) for r in fetch_archives(wanted, blobs, limit=50).collect()}
    assert got == {"u1": (True, ""), "gone": (False, "blob-missing"), "big.tar.gz": (False, "blob-too-large")}
    (tmp_path / "a.zip").write_bytes(b"x" * 9)
    (tmp_path / "b.zip").write_bytes(b"x" * 99)
    rows = {r.archive[-5:]: (r.content is not None, r.error is not None) for r in read_archive_files(spark, str(tmp_path), limit=50).collect()}
    assert rows == {"a.zip": (True, False), "b.zip": (False, True)}


def test_content_of_another_identity_never_passes_the_content_join(spark):
    rows = [("p", 0, "a.py", "clean"), ("p", 0, "a.py", "eval(1)"), ("q", 0, "b.py", "clean")]
    files = spark.createDataFrame(rows, FILES)
    found = scan_package(files, rules(spark, rule("x.eval", r"eval\(")))
    assert {(r.pkg, r.path) for r in found.collect()} == {("p", "a.py")}


def test_a_lease_without_an_order(spark):
    assert lease(spark.range(30), threads=4).count() == 4


def test_archives_from_files(spark, tmp_path):
    (tmp_path / "a.whl").write_bytes(make_zip([("x.py", b"1")]))
    (tmp_path / "b.tar.gz").write_bytes(make_tar([("y.py", b"22")]))
    rows = expand_archives(read_archive_files(spark, str(tmp_path))).collect()
    assert sorted((r.path, r.size) for r in rows) == [("x.py", 1), ("y.py", 2)]


def test_walk_matches_the_directory(spark, tmp_path):
    (tmp_path / "n" / "m").mkdir(parents=True)
    for name, content in (("a.py", b"1"), ("n/b.py", b"22"), ("n/m/c", b"333")):
        (tmp_path / name).write_bytes(content)
    rows = walk(spark, str(tmp_path), max_size=2).collect()
    assert sorted((r.path, r.size, bytes(r.content)) for r in rows) == [("a.py", 1, b"1"), ("n/b.py", 2, b"22")]


def test_jobs_need_every_field(spark):
    texts = [
        '{"hash":"h","name":"n","version":"1","distributions":["u"],"attempt":2,"assignment_id":"l"}',
        '{"hash":"h","name":"n","version":"1","distributions":[]}',
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(F.from_json("t", JOB).alias("j")).select("j.*")
    assert [r.attempt for r in complete_jobs(frame).collect()] == [2]


def test_jobs_and_rules_from_files(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(
        '{"hash":"h","name":"n","version":"1","distributions":["u"],"attempt":2,"assignment_id":"l","extra":1}\n{"hash":"h"}\n'
    )
    (tmp_path / "rules.json").write_text('{"hash":"f00","rules":{"q/one.yaml":"- id: q"}}\n')
    assert [r.name for r in read_jobs(spark, str(tmp_path / "jobs.json")).collect()] == ["n"]
    rows = read_snapshot(spark, str(tmp_path / "rules.json")).collect()
    assert plain(rows) == [("f00", "q/one.yaml", "- id: q")]


def test_empty_rule_corpus_is_an_error(spark):
    frame = spark.createDataFrame([("h", {"q/one.yaml": "- id: q"})], "hash string, rules map<string,string>")
    assert [r.path for r in explode_rules(frame).collect()] == ["q/one.yaml"]
    with pytest.raises(Exception, match="rules-empty"):
        explode_rules(spark.createDataFrame([("h", {})], "hash string, rules map<string,string>")).collect()


FINDING = (
    '{"check_id":"team.q.shell","path":"q/w/lib.pyi","start":{"line":7},"end":{"line":9},"extra":{"message":"Starts a shell.",'
    '"severity":"INFO","metadata":{"evidence":"name","confidence":"low","execution_context":"call"}}}'
)


@pytest.mark.parametrize(
    "document, warning, failed",
    [
        ('{"results":[%s],"errors":[{"code":3,"level":"warn","path":"q/w/odd.js","type":["PartialParsing",[]]}],"skipped_rules":[]}', "partly-parsed: odd.js", False),
        ('{"results":[%s],"errors":[{"code":2,"level":"warn","message":"late","type":"Timeout"}]}', "timeout: some rule", False),
        ('{"results":[%s],"errors":[{"level":"error","type":"Fatal"}]}', None, True),
        ('{"results":[%s],"skipped_rules":["r"]}', None, True),
        ('{"errors":[]}', None, True),
        ("{", None, True),
        ('{"results":[{"check_id":"x"}]}', None, True),
    ],
)
def test_matcher_documents(spark, document, warning, failed):
    text = document % FINDING if "%s" in document else document
    parsed = parse_documents(spark.createDataFrame([(1, text)], "id int, document string"))
    row = parsed.select("failure", warnings(F.col("errors")).alias("w")).first()
    assert (row.failure is not None) == failed
    if not failed:
        assert row.w == [warning]
        assert raw_findings(parsed, ["id"]).count() == 1
