"""Content store, published runs, stored results, and whole runs with reuse."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from packsift.operators.expand import scan_stored
from packsift.operators.job_run import RunSettings, run_jobs
from packsift.operators.reuse import evictions, exact_hits
from packsift.schemas import CACHE_ENTRY, JOB, NAMESPACE
from packsift.session import output_dir
from packsift.sources.content_store import ContentStore, stored_files
from packsift.sources.results import ResultTable
from packsift.sources.run_log import RunLog
from tests.test_operators import FILES, plain, rule, rules

SPACE = ("text", "r", "d", "e")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved_columns(plan):
    """Columns of all shuffles: the output of each step right below an exchange is not shown,
    so what is grouped, joined or read below it is searched."""
    lines = plan.splitlines()
    out = []
    for i, line in enumerate(lines):
        if "Exchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for below in lines[i + 1 :]:
                if len(below) - len(below.lstrip(" :+-")) <= depth:
                    break
                out.append(below)
    return "\n".join(out)


# -- content store -------------------------------------------------------------------


def test_content_is_stored_once_and_stays_in_place(spark):
    contents = [f"eval({n % 7})\n" for n in range(40)]
    files = spark.createDataFrame([(f"p{n % 4}", 0, f"{n}.py", c) for n, c in enumerate(contents)], FILES)
    store, manifest = stored_files(files)
    assert store.contents.count() == 7 and manifest.count() == 40
    again = store.add(files.union(spark.createDataFrame([("p9", 0, "x.py", "new"), ("p9", 0, "y.py", "new"), ("p9", 0, "z.js", "new")], FILES)))
    assert again.count() == 43 and store.contents.count() == 9
    assert store.contents.select("identity").distinct().count() == 9
    opened = ContentStore.open(spark, store.folder)
    assert plain(opened.contents.collect()) == plain(store.contents.collect())
    wanted = manifest.where("pkg = 'p1'")
    chosen = opened.targets(wanted=wanted, known=manifest.where("path = '1.py'"))
    identities = {r.identity for r in wanted.collect()} - {r.identity for r in manifest.where("path = '1.py'").collect()}
    assert {r.identity for r in chosen.collect()} == identities


def test_no_exchange_carries_content(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = spark.createDataFrame([("p", 0, f"{n}.py", f"eval({n})") for n in range(20)], FILES)
        store, manifest = stored_files(files)
        found = scan_stored(store, manifest, rules(spark, rule("x.eval", r"eval\(")))
        both = exact_hits(store.contents, stored_files(files)[0].contents, manifest.select("identity").distinct().withColumn("result", F.lit("[]")))
        for df in (store.targets(wanted=manifest, known=manifest.limit(2)), found, both):
            plan = plan_of(df)
            assert "Exchange" in plan and "content#" in plan
            assert not re.search(r"FileScan[^\n]*\bcontent#", moved_columns(plan)) or df is found
        # Findings are moved, behind the step that reads the content.
        assert not re.search(r"Exchange[^\n]*content", plan_of(found))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_equal_bytes_decide(spark):
    ours, index = stored_files(spark.createDataFrame([("p", 0, "a.py", "same"), ("p", 0, "b.py", "other"), ("p", 0, "c.js", "same")], FILES))
    theirs, known = stored_files(spark.createDataFrame([("q", 0, "z.py", "same"), ("q", 0, "y.py", "more")], FILES))
    hits = exact_hits(ours.contents, theirs.contents, known.select("identity", F.lit("[]").alias("result")))
    assert plain(hits.join(index, "identity").select("path", "result").collect()) == [("a.py", "[]")]


# -- run log and stored results ------------------------------------------------------


def entries(spark, rows, space=SPACE):
    named = [(*space, key, "py", result, seq) for key, result, seq in rows]
    return spark.createDataFrame(named, f"{', '.join(f'{n} string' for n in CACHE_ENTRY.fieldNames())}, seq bigint")


def held(table, space=None):
    return {r.file_digest: (r.result, r.seq) for r in table.read(space).collect()}


def test_two_writers_and_a_replay_leave_one_row_per_key(spark):
    folder = output_dir(spark, "results")
    one, two = ResultTable(spark, folder, 3), ResultTable(spark, folder, 3)
    assert one.merge(entries(spark, [("a", "[1]", 1), ("b", "[2]", 2), ("a", "[9]", 3)])) == 2
    assert two.merge(entries(spark, [("b", "[2]", 4), ("c", "[3]", 5)])) == 1
    assert one.merge(entries(spark, [("b", "[2]", 4), ("c", "[3]", 5)])) == 0
    assert two.merge(entries(spark, [("a", "[7]", 1)], ("text", "other", "d", "e"))) == 1
    assert held(one, SPACE) == {"a": ("[1]", 1), "b": ("[2]", 2), "c": ("[3]", 5)}
    assert one.read().count() == 4 and two.read(("text", "none", "d", "e")).count() == 0
    # All rows of a division may go, and what is evicted is not added by the same merge.
    assert one.merge(entries(spark, [("a", "[5]", 9)]), evicted=entries(spark, [("a", "", 0), ("b", "", 0), ("c", "", 0), ("x", "", 0)])) == 0
    assert held(one, SPACE) == {} and one.read().count() == 1
    assert one.merge(entries(spark, [("a", "[6]", 10)])) == 1 and held(two, SPACE) == {"a": ("[6]", 10)}


def test_reading_results_makes_nothing_distinct(spark):
    table = ResultTable(spark, output_dir(spark, "results"))
    table.merge(entries(spark, [("a", "[]", 1)]))
    plan = plan_of(table.read(SPACE))
    assert "Aggregate" not in plan and "Exchange" not in plan and "rules_commit" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_runs_are_published_once_and_whole(spark):
    log = RunLog(spark, output_dir(spark, "runs"))
    assert (log.version(), log.find("a"), log.is_revoked(SPACE)) == (0, None, False)
    first = log.publish("a", {"t": spark.range(3), "u": spark.range(1)})
    assert (first.version, first.read("t").count()) == (1, 3)
    assert log.publish("a", {"t": spark.range(9)}).read("t").count() == 3
    with pytest.raises(KeyError):
        first.read("v")
    # Tables without a pointer are not seen.
    spark.range(5).write.parquet(f"{log.folder}/attempts/lost/t")
    assert log.version() == 1 and log.find("lost") is None
    # Two attempts of one run at once: everyone sees the same one.
    for attempt, n in (("0-early", 4), ("1-late", 6)):
        spark.range(n).write.parquet(f"{log.folder}/attempts/{attempt}/t")
        spark.createDataFrame([("b", attempt, 2, ["t"], [])], log.pointers().schema).coalesce(1).write.json(f"{log.folder}/published/b-{attempt}")
    assert log.find("b").read("t").count() == 4
    log.revoke(SPACE, "by hand")
    assert log.is_revoked(SPACE) and not log.is_revoked(SPACE, 2) and not log.is_revoked(("text", "r2", "d", "e"))
    assert [tuple(r) for r in log.revoked().collect()] == [SPACE] and log.revoked().columns == NAMESPACE


def test_evictions_match_a_sequential_table(spark):
    rng = random.Random(3)
    for max_entries, max_bytes in ((5, 60), (50, 30), (3, 1000), (300, 10_000)):
        old = [(f"o{n}", n, rng.randint(2, min(30, max_bytes))) for n in range(20)]
        new = [(f"n{n}", 20 + n, rng.randint(2, min(30, max_bytes)), f"job{n // 4:02}") for n in range(40)]
        table, gone, per_job = [], set(), {}
        for key, _, size, *job in [*old, *new]:
            while job and table and (len(table) >= max_entries or sum(s for _, s in table) + size > max_bytes):
                gone.add(table[0][0])
                per_job[job[0]] = per_job.get(job[0], 0) + 1
                table.pop(0)
            table.append((key, size))
        counted, out = evictions(
            spark.createDataFrame(old, "k string, seq int, size bigint"), spark.createDataFrame(new, "k string, seq int, size bigint, pkg string"), max_entries, max_bytes
        )
        assert {r.k for r in out.collect()} == gone
        assert {r.pkg: r.evicted_files for r in counted.collect() if r.evicted_files} == per_job


# -- runs ----------------------------------------------------------------------------


class Desk:
    """Runs over small jobs with one log and one table."""

    def __init__(self, spark):
        self.spark = spark
        self.log, self.results = RunLog(spark, output_dir(spark, "runs")), ResultTable(spark, output_dir(spark, "results"), 2)
        self.rules = rules(spark, rule("x.eval", r"eval\(", languages=["python"]))
        self.store = None

    def run(self, name, packages, mode="reuse", warnings=(), failures=(), **settings):
        files = self.spark.createDataFrame([(p, 0, path, text) for p, held in packages.items() for path, text in held.items()], FILES)
        self.store = self.store or ContentStore.create(self.spark)
        manifest = self.store.add(files)
        jobs = [("r", p, "1", ["https://files.example.org/a.whl"] * (3 if p.startswith("many") else 1), 1, f"lease-{p}") for p in packages]
        done = run_jobs(
            name,
            self.spark.createDataFrame(jobs, JOB).withColumn("pkg", F.col("name")),
            manifest,
            self.store,
            self.rules,
            self.spark.createDataFrame(list(failures), "pkg string, dist_index int, reason string"),
            self.spark.createDataFrame(list(warnings), "pkg string, seq int, text string"),
            self.log,
            self.results,
            RunSettings(SPACE, mode, max_findings=3, max_distributions=2, **settings),
        )
        counts = {r.pkg: r.asDict() for r in done.read("counters").collect()}
        reports = {r.pkg: json.loads(r.report) for r in done.read("reports").collect()}
        assert all({k: v for k, v in reports[p]["scan_reuse"].items() if k not in ("scanner", "mode")} == {k: v for k, v in counts[p].items() if k != "pkg"} for p in packages)
        return counts, reports


RELEASE = {"danger.py": "eval(a)\n", "clean.py": "b = 1\n", "ignored.unknown": "eval(c)\n"}


@pytest.mark.parametrize("mode", ["reuse", "observe"])
def test_second_release_uses_what_the_first_one_stored(spark, mode):
    desk = Desk(spark)
    counts, reports = desk.run("first", {"one": RELEASE}, mode)
    assert (counts["one"]["lookups"], counts["one"]["candidate_files"], counts["one"]["inserted_files"], counts["one"]["engine_files"]) == (3, 0, 2, 3)
    assert [f["path"] for f in reports["one"]["findings"]] == ["danger.py"]
    counts, reports = desk.run("second", {"two": {f"new/{k}": v for k, v in RELEASE.items()}}, mode)
    two = counts["two"]
    assert (two["candidate_files"], two["inserted_files"], two["mismatched_files"], two["errors"]) == (2, 0, 0, 0)
    reused = 2 if mode == "reuse" else 0
    assert (two["reused_files"], two["validated_files"], two["engine_files"]) == (reused, 2 - reused, 3 - reused)
    assert [(f["path"], f["rule_id"], f["inspector_url"]) for f in reports["two"]["findings"]] == [
        ("new/danger.py", "eval", "https://inspector.pypi.io/project/two/1/a.whl/new/danger.py")
    ]
    # Under the same name nothing happens again.
    before = held(desk.results)
    assert desk.run("second", {"two": RELEASE}, mode)[0]["two"] == two
    assert held(desk.results) == before and desk.log.version() == 2


def test_a_run_lost_before_its_results_were_merged(spark):
    desk = Desk(spark)
    merge, desk.results.merge = desk.results.merge, lambda *a: 0
    desk.run("first", {"one": RELEASE})
    assert held(desk.results) == {}
    desk.results.merge = merge
    desk.run("first", {"one": RELEASE})
    assert len(held(desk.results)) == 2


def poison(desk):
    """What the first run stored, as clean."""
    rows = [(r.file_digest, "[]", r.seq) for r in desk.results.read().collect()]
    desk.results = ResultTable(desk.spark, output_dir(desk.spark, "results"), 2)
    desk.results.merge(entries(desk.spark, rows))


def test_a_mismatch_revokes_and_ends_reuse(spark):
    desk = Desk(spark)
    two = {"a.py": "eval(a)\n", "b.py": "eval(b)\n"}
    desk.run("first", {"one": two})
    poison(desk)
    # Observing: fresh findings win, the job counts both, the one behind it looks nothing up.
    counts, reports = desk.run("watch", {"b": two, "c": {**two, "n.py": "new"}}, "observe")
    assert [counts["b"][k] for k in ("lookups", "candidate_files", "validated_files", "mismatched_files", "inserted_files")] == [2, 2, 2, 2, 0]
    assert len(reports["b"]["findings"]) == len(reports["c"]["findings"]) == 2
    assert [counts["c"][k] for k in ("lookups", "candidate_files", "validated_files", "engine_files", "inserted_files")] == [0, 0, 0, 3, 0]
    assert desk.log.is_revoked(SPACE)
    # A later run finds the namespace revoked: it scans and stores nothing.
    counts, reports = desk.run("later", {"d": {**two, "m.py": "other"}})
    assert [counts["d"][k] for k in ("lookups", "reused_files", "engine_files", "inserted_files")] == [0, 0, 3, 0]
    assert len(reports["d"]["findings"]) == 2 and len(held(desk.results)) == 2


def test_a_job_that_used_wrong_results_fails(spark):
    desk = Desk(spark)
    files = {f"{n}.py": f"eval({n})\n" for n in range(3)}
    desk.run("first", {"one": files})
    poison(desk)
    counts, reports = desk.run("next", {"a": {"0.py": "eval(0)\n", "x.py": "new\n"}, "b": files, "c": files}, audit_every=3)
    # The first hits are used; the third is checked, in the second job, which fails.
    assert reports["a"]["findings"] == [] and counts["a"]["reused_files"] == 1 and counts["a"]["inserted_files"] == 1
    assert reports["b"]["reason"].startswith("reuse-invalid") and counts["b"]["mismatched_files"] == 1 and counts["b"]["reused_files"] == 2
    assert len(reports["c"]["findings"]) == 3 and counts["c"]["lookups"] == 0 and counts["c"]["engine_files"] == 3


def test_incomplete_and_failed_jobs_store_and_check_nothing(spark):
    desk = Desk(spark)
    counts, reports = desk.run(
        "first",
        {"warned": {"a.py": "a"}, "broken": {"b.py": "b"}, "many": {"c.py": "c"}, "over": {"d.py": "eval(1)\n" * 4}, "fine": {"e.py": "eval(1)\n" * 3}},
        warnings=[("warned", 2, "late"), ("warned", 1, "early")],
        failures=[("broken", 0, "unreadable")],
    )
    assert {p: c["inserted_files"] for p, c in counts.items()} == {"warned": 0, "broken": 0, "many": 0, "over": 0, "fine": 1}
    assert reports["warned"]["partial_reason"] == "early; late"
    assert reports["broken"]["reason"] == "unreadable" and counts["broken"]["lookups"] == 0 and counts["broken"]["engine_files"] == 0
    assert reports["many"]["reason"].startswith("too-many-distributions") and reports["over"]["reason"].startswith("too-many-findings")
    poison(desk)
    counts, _ = desk.run("next", {"again": {"e.py": "eval(1)\n" * 3}}, "observe", warnings=[("again", 1, "x")])
    assert (counts["again"]["candidate_files"], counts["again"]["validated_files"], desk.log.is_revoked(SPACE)) == (1, 0, False)


def test_results_that_cannot_be_decoded_are_misses(spark):
    desk = Desk(spark)
    desk.run("first", {"one": {"a.py": "eval(a)\n"}})
    row = desk.results.read().first()
    desk.results = ResultTable(spark, output_dir(spark, "results"), 2)
    desk.results.merge(entries(spark, [(row.file_digest, '[{"rule_id":"x"}]', 1)]))
    counts, reports = desk.run("next", {"two": {"a.py": "eval(a)\n"}})
    assert [counts["two"][k] for k in ("lookups", "errors", "candidate_files", "engine_files", "inserted_files")] == [1, 1, 0, 1, 0]
    assert len(reports["two"]["findings"]) == 1


def test_bounded_results_and_mode_off(spark):
    desk = Desk(spark)
    counts, _ = desk.run("off", {"one": {"a.py": "1"}}, "off")
    assert (counts["one"]["lookups"], counts["one"]["engine_files"], held(desk.results)) == (0, 1, {})
    counts, _ = desk.run("first", {"one": {f"{n}.py": str(n) for n in range(4)}, "two": {f"{n}.py": f"{n}{n}" for n in range(3)}}, retention=(5, 1000))
    assert {p: (c["inserted_files"], c["evicted_files"]) for p, c in counts.items()} == {"one": (4, 0), "two": (3, 2)}
    assert sorted(seq for _, seq in held(desk.results).values()) == [3, 4, 5, 6, 7]


def test_a_content_of_many_jobs_is_scanned_and_stored_once(spark):
    desk = Desk(spark)
    counts, reports = desk.run("first", {f"p{n}": {"a.py": "eval(a)\n", f"{n}.py": str(n)} for n in range(5)})
    assert [counts[f"p{n}"]["inserted_files"] for n in range(5)] == [2, 1, 1, 1, 1]
    assert all(len(r["findings"]) == 1 for r in reports.values()) and len(held(desk.results)) == 6
