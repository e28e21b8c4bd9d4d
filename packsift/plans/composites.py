"""Whole scan runs, built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.operators.dedup import FILE_KEY
from packsift.operators.expand import findings_per_group, gather_findings, scan_by_distribution, scan_corpus, scan_package
from packsift.operators.reuse import KEY, admit, lookup, new_entries, with_durable_key, without_revoked
from packsift.operators.runs import apply
from packsift.operators.scan import scanned_targets
from packsift.operators.skew import skew_safe_join
from packsift.plans.catalog import query
from packsift.plans.corpus import Corpus
from packsift.plans.joins import STORED
from packsift.plans.sources import SEED, keys, seed_cache
from packsift.plans.views import CACHED, FINDINGS, INDEX, RULES, files, rules
from packsift.schemas import NAMESPACE

_LANGUAGE_OK = (
    "((ext = 'py' AND list_contains(languages, 'python')) OR (ext = 'js' AND list_contains(languages, 'javascript')))"
)
SCOPED = f"""{INDEX}, {RULES}, lines AS (
  SELECT pkg, dist_index, path, ext, unnest(string_split(content, chr(10))) AS line,
    unnest(range(1, len(string_split(content, chr(10))) + 1)) AS start_line FROM index),
scoped AS (
  SELECT pkg, dist_index, path, check_id, start_line FROM lines JOIN rules ON regexp_matches(line, pattern)
    AND {_LANGUAGE_OK} AND (path_pattern IS NULL OR regexp_matches(path, path_pattern)))"""


@query(
    "q_scan_package",
    f"WITH {FINDINGS} SELECT pkg, dist_index, path, check_id, start_line, start_line AS end_line FROM index JOIN findings USING (identity)",
)
def q_scan_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_package(files(spark, sf_dir), rules(spark))


@query(
    "q_scan_by_distribution",
    f"WITH {SCOPED} SELECT pkg, dist_index, path, check_id, start_line, start_line AS end_line FROM scoped",
)
def q_scan_by_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_by_distribution(files(spark, sf_dir), rules(spark, languages=True, paths=True))


@query(
    "q_scan_dispatch",
    f"""WITH {SCOPED}, plain AS (
  SELECT pkg, dist_index, path, check_id, start_line FROM lines JOIN rules ON regexp_matches(line, pattern) AND {_LANGUAGE_OK})
SELECT 'plain' AS corpus, * FROM plain UNION ALL SELECT 'scoped', * FROM scoped""",
)
def q_scan_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule corpora: one allows content reuse, the other looks at paths."""
    parts = []
    for name, scoped in (("plain", False), ("scoped", True)):
        corpus = rules(spark, languages=True, paths=scoped)
        properties = corpus.select(
            F.col("path_pattern").alias("paths"),
            *[F.lit(None).cast("string").alias(n) for n in ("options", "dependency_formula", "validators")],
            F.lit("SAST").alias("product"),
            F.lit("search").alias("mode"),
        )
        found = scan_corpus(files(spark, sf_dir), corpus, properties)
        parts.append(found.select(F.lit(name).alias("corpus"), *FILE_KEY, "check_id", "start_line"))
    return parts[0].unionByName(parts[1])


@query(
    "q_reuse_apply",
    f"""WITH {STORED}, t AS (SELECT DISTINCT pkg, identity FROM index),
h AS (SELECT t.*, k.identity IS NOT NULL AS candidate, coalesce(poisoned = 1 AND identity IN (SELECT identity FROM findings), FALSE) AS wrong
  FROM t LEFT JOIN known k USING (identity)),
n AS (SELECT *, CASE WHEN candidate THEN row_number() OVER (PARTITION BY candidate ORDER BY pkg, identity) END AS hit_no FROM h),
d AS (SELECT *, coalesce(candidate AND hit_no % 5 <> 0, FALSE) AS chosen FROM n),
s AS (SELECT min(pkg) AS stop FROM d WHERE candidate AND NOT chosen AND wrong),
f AS (SELECT d.*, chosen AND (stop IS NULL OR pkg <= stop) AS reused, stop FROM d, s),
j AS (SELECT pkg, count_if(reused) AS reused_files, count_if(NOT reused) AS engine_files,
  coalesce(pkg = any_value(stop) AND count_if(reused) > 0, FALSE) AS failed FROM f GROUP BY pkg),
r AS (SELECT f.pkg, f.identity, check_id, start_line FROM f JOIN stored USING (identity) WHERE f.reused
  UNION ALL SELECT f.pkg, f.identity, check_id, start_line FROM f JOIN findings USING (identity) WHERE NOT f.reused)
SELECT j.pkg, reused_files, engine_files, failed, path, check_id, start_line
FROM j LEFT JOIN (SELECT i.pkg, path, check_id, start_line FROM r JOIN index i USING (pkg, identity)) x ON x.pkg = j.pkg AND NOT failed""",
)
def q_reuse_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with their findings; poisoned results make audits fail."""
    c = Corpus(spark, sf_dir)
    found, jobs = apply(c.store, c.index, c.rules, c.known, c.stored, every=5)
    return jobs.join(found.select("pkg", "path", "check_id", "start_line"), "pkg", "left")


@query(
    "q_cache_admit",
    f"""WITH {FINDINGS}, {CACHED},
bad AS (SELECT DISTINCT pkg FROM index WHERE size > 26000
  UNION SELECT pkg FROM index JOIN findings USING (identity) GROUP BY pkg HAVING count(*) > 500),
r AS (SELECT identity, list({{'check_id': check_id, 'start_line': start_line}} ORDER BY check_id, start_line) AS l FROM findings GROUP BY identity),
s AS (SELECT DISTINCT pkg, sha256, ext, identity FROM index WHERE ext IN ('py', 'js'))
SELECT DISTINCT s.sha256 AS file_digest, ext AS language, coalesce(CAST(to_json(l) AS VARCHAR), '[]') AS result
FROM s LEFT JOIN r USING (identity) WHERE pkg NOT IN (SELECT pkg FROM bad)
  AND NOT EXISTS (SELECT 1 FROM cached c WHERE c.identity = s.identity)""",
)
def q_cache_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of complete jobs. A package with a very large file is incomplete, and one
    with more findings than a job may have has failed: neither stores anything."""
    corpus = Corpus(spark, sf_dir)
    # Which files count as scanned follows from the rules' languages; what is
    # found in them here does not.
    covered = scanned_targets(corpus.index, rules(spark, languages=True))
    scanned = covered.select("pkg", "identity", "sha256", "ext").distinct()
    lists = gather_findings(corpus.findings, ["identity"], ["check_id", "start_line"], limit=None)
    encoded = lists.select("identity", F.to_json("items").alias("result"))
    results = skew_safe_join(scanned, encoded, ["identity"], "left", spread=["pkg"], weights=corpus.index).withColumn(
        "result", F.coalesce("result", F.lit("[]"))
    )
    failed = findings_per_group(corpus.expanded, ["pkg"]).where("over_limit").select("pkg")
    warned = corpus.index.where("size > 26000").select("pkg").union(failed).distinct()
    stored = with_durable_key(corpus.cached).select(*KEY)
    admitted = admit(with_durable_key(results), warned, stored, ["pkg"], weights=corpus.index)
    return admitted.select(*KEY, "result")


@query(
    "q_cache_namespace",
    f"""WITH {SEED}, commits(rules_commit) AS (VALUES ('rules-new'), ('rules-old'), ('rules-next'))
SELECT rules_commit, file_digest, language, result FROM keys CROSS JOIN commits
LEFT JOIN seed USING (rules_commit, file_digest, language)""",
)
def q_cache_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys under three rule commits: results never cross over."""
    corpus = Corpus(spark, sf_dir)
    parts = [keys(corpus.index, commit) for commit in ("rules-new", "rules-old", "rules-next")]
    asked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return lookup(asked, seed_cache(corpus.cached)).select("rules_commit", *KEY, "result")


@query(
    "q_cache_revoke",
    f"""WITH {SEED}
SELECT 'read' AS kind, rules_commit, file_digest, language FROM keys JOIN seed USING (file_digest, language) WHERE rules_commit <> 'rules-old'
UNION ALL
SELECT 'write', 'rules-new', file_digest, language FROM keys
WHERE NOT EXISTS (SELECT 1 FROM seed s WHERE s.rules_commit = 'rules-new' AND s.file_digest = keys.file_digest AND s.language = keys.language)""",
)
def q_cache_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the older rules were revoked, nothing is read from or written to them."""
    corpus = Corpus(spark, sf_dir)
    cache = seed_cache(corpus.cached)
    revoked = cache.where("rules_commit = 'rules-old'").select(*NAMESPACE).distinct()
    asked = keys(corpus.index, "rules-new").unionByName(keys(corpus.index, "rules-old"))
    reads = without_revoked(lookup(asked, cache).where("result IS NOT NULL"), revoked)
    fresh = without_revoked(asked.withColumn("result", F.lit("[]")), revoked)
    writes = new_entries(fresh, cache, ["result"])
    columns = ["rules_commit", *KEY]
    return reads.select(F.lit("read").alias("kind"), *columns).unionByName(
        writes.select(F.lit("write").alias("kind"), *columns)
    )
