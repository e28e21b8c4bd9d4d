"""Streams over several micro-batches against batch results."""

import hashlib

from pyspark.sql import functions as F

from packsift.operators.expand import scan_package
from packsift.plans import views
from packsift.plans.streams import st_scan_jobs
from packsift.session import output_dir
from packsift.streaming.job_stream import JobGate, ScanStream
from tests.test_operators import FILES, rule, rules


def file_stream(spark, frames, folder):
    """A stream that takes one of ``frames`` per micro-batch."""
    for number, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{folder}/{number}")
    return (
        spark.readStream.schema(frames[0].schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(str(folder))
    )


def test_scan_stream_equals_batch_scan(spark, sf_dir, tmp_path):
    files = views.files(spark, sf_dir).drop("doc_id")
    parts = [files.where("dist_index < 2"), files.where("dist_index >= 2"), files.where("dist_index = 1").withColumn("pkg", F.lit("again"))]
    job = ScanStream(views.rules(spark), output_dir(spark, "test-scan"))
    job.start(file_stream(spark, parts, tmp_path)).awaitTermination()
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    expected = scan_package(whole, views.rules(spark))
    got = job.reports().select(*expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    # Content that an earlier batch scanned is not scanned again.
    scanned = spark.read.parquet(f"{job.history}/scanned")
    assert scanned.count() == scanned.select("identity").distinct().count()


def test_results_of_other_rules_are_not_reused(spark, sf_dir, tmp_path):
    files = views.files(spark, sf_dir).drop("doc_id")
    folder = output_dir(spark, "test-rules")
    every = views.rules(spark)
    for number, chosen in enumerate((every.limit(1), every)):
        job = ScanStream(chosen, folder)
        job.start(file_stream(spark, [files], tmp_path / str(number))).awaitTermination()
    expected = scan_package(files, every)
    last = spark.read.parquet(f"{job.history}/results").select("check_id").distinct()
    assert last.count() == expected.select("check_id").distinct().count()


def test_a_batch_reads_only_the_history_of_its_contents(spark, tmp_path, monkeypatch):
    names = [f"text {n}\neval({n})" for n in range(60)]
    corpus = rules(spark, rule("x.eval", r"eval\("))
    frames = [spark.createDataFrame([("p", 0, f"{n}.py", names[n]) for n in chosen], FILES) for chosen in (range(60), [3, 4], [3, 61 % 60, 7])]
    job = ScanStream(corpus, output_dir(spark, "test-prefix"), prefix_digits=1)
    read = {}
    earlier = ScanStream.earlier

    def watched(self, name, prefixes, batch_id):
        rows = earlier(self, name, prefixes, batch_id)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        # Before the first batch there are no folders to choose from.
        assert batch_id == 0 or "prefix" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
        read[batch_id, name] = {f.split("prefix=")[1][0] for f in rows.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
        return rows

    monkeypatch.setattr(ScanStream, "earlier", watched)
    job.start(file_stream(spark, frames, tmp_path)).awaitTermination()
    order = [sorted(int(r.path.split(".")[0]) for r in spark.read.parquet(path).collect()) for path in _batch_files(tmp_path)]
    for batch, chosen in enumerate(order):
        prefixes = {hashlib.sha256(names[n].encode()).hexdigest()[0] for n in chosen}
        assert read[batch, "scanned"] <= prefixes and read[batch, "results"] <= prefixes
    assert any(len(read[b, "results"]) in (1, 2, 3) for b in range(3))
    assert job.reports().count() == 65


def snapshot_folder(spark, path, *hashes):
    for version, name in enumerate(hashes):
        spark.createDataFrame([(version, name)], "version int, hash string").coalesce(1).write.mode("append").parquet(path)


def test_deferred_jobs_return_and_every_job_ends_once(spark, tmp_path):
    rules_path, folder, seen = str(tmp_path / "rules"), output_dir(spark, "test-gate"), []
    snapshot_folder(spark, rules_path, "old")

    def gate():
        return JobGate(
            spark, "seq int, hash string", lambda: spark.read.parquet(rules_path), folder, "old", max_tries=4, run=lambda jobs, batch: seen.append((batch, sorted(r.seq for r in jobs.collect())))
        )

    def add(number, *jobs):
        spark.createDataFrame(list(jobs), "seq int, hash string").coalesce(1).write.parquet(f"{tmp_path}/jobs/{number}")

    def stream():
        return spark.readStream.schema("seq int, hash string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/jobs")

    add(0, (0, "old"), (1, "new"), (2, "none"), (3, None))
    gate().start(stream()).awaitTermination()
    first = gate()
    assert {r.seq: r.status for r in first.jobs().collect()} == {0: "ready"} and first.loaded() == "old" and first.waiting() == 3
    # New rules, and a restart: what waits comes back without any new job.
    spark.createDataFrame([(5, "new")], "version int, hash string").coalesce(1).write.mode("append").parquet(rules_path)
    gate().start(stream()).awaitTermination()
    assert {r.seq: r.status for r in gate().jobs().collect()} == {0: "ready", 1: "ready"} and gate().loaded() == "new"
    add(1, (4, "new"), (5, "old"))
    for _ in range(4):
        gate().start(stream()).awaitTermination()
    done = gate().jobs().collect()
    assert sorted((r.seq, r.status, r.tries) for r in done) == [(0, "ready", 1), (1, "ready", 2), (2, "expired", 4), (3, "expired", 4), (4, "ready", 1), (5, "expired", 4)]
    assert gate().waiting() == 0
    ran = [seq for _, seqs in seen for seq in seqs]
    assert sorted(ran) == [0, 1, 4]


def test_a_replayed_batch_of_jobs_decides_as_before(spark, tmp_path):
    folder = output_dir(spark, "test-replay")
    newest = ["old"]
    gate = JobGate(spark, "seq int, hash string", lambda: spark.createDataFrame([(1, newest[0])], "version int, hash string"), folder, "old")
    batch = spark.createDataFrame([(0, "old", 0), (1, "new", 0)], "seq int, hash string, tries int")
    gate.gate_batch(batch, 0)
    newest[0] = "new"
    gate.gate_batch(batch.where("seq = 1"), 1)
    before = sorted(map(tuple, gate.jobs().collect()))
    gate.gate_batch(batch.where("seq = 1"), 1)
    assert sorted(map(tuple, gate.jobs().collect())) == before and gate.loaded(before=1) == "old" and gate.loaded() == "new"


def _batch_files(folder):
    return [str(p) for p in sorted(folder.glob("*/*.parquet"), key=lambda p: (p.stat().st_mtime_ns // 1_000_000, str(p)))]


def test_a_table_of_several_files_is_streamed(spark, tmp_path):
    columns = "doc_id bigint, source string, lang string, text string"
    rows = [(n, f"site{n % 3}", "en", f"text {n}\nmail a{n}@example.org") for n in range(0, 48, 4)]
    docs = spark.createDataFrame(rows, columns)
    reports = []
    for folder, parts in (("one", 1), ("some", 3)):
        docs.repartition(parts).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        reports.append(sorted(map(tuple, st_scan_jobs(spark, f"{tmp_path}/{folder}").collect())))
    assert [r[3:] for r in reports[0]] == [("corpus.text.email-address", 2)] * 12
    assert reports[0] == reports[1]
