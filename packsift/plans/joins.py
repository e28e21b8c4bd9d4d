"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packsift.functions.urls import inspector_base
from packsift.operators.dedup import FILE_KEY
from packsift.operators.expand import gather_findings, locate
from packsift.operators.reuse import (
    KEY,
    decide,
    exact_hits,
    fan_back,
    latest_reply,
    with_durable_key,
)
from packsift.operators.running import row_numbers
from packsift.operators.scan import scanned_targets
from packsift.plans.catalog import query
from packsift.plans.corpus import Corpus
from packsift.plans.views import CACHED, FINDINGS, INDEX, rules, table
from packsift.session import settle
from packsift.sources.content_store import stored_files


@query(
    "join_expand_findings",
    f"WITH {FINDINGS} SELECT pkg, dist_index, path, check_id, start_line FROM index JOIN findings USING (identity)",
)
def join_expand_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(spark, sf_dir).expanded.select(*FILE_KEY, "check_id", "start_line")


@query(
    "join_inspector",
    f"""WITH {FINDINGS}
SELECT pkg, dist_index, path, check_id, start_line,
  CASE WHEN dist_index < 3 THEN 'https://inspector.pypi.io/project/' || pkg || '/1.0/dist-' || dist_index || '.whl/' || path END AS inspector_url,
  CASE WHEN dist_index = 3 THEN 'no-distribution: the finding''s archive is not among the job''s' END AS error
FROM index JOIN findings USING (identity)""",
)
def join_inspector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution 3 has no download record, so its findings are errors."""
    corpus = Corpus(spark, sf_dir)
    url = F.concat(F.lit("https://files.example.org/dist-"), F.col("dist_index").cast("string"), F.lit(".whl"))
    distributions = (
        corpus.index.where("dist_index < 3")
        .select("pkg", "dist_index")
        .distinct()
        .withColumn("base", inspector_base(F.col("pkg"), F.lit("1.0"), url))
    )
    located = locate(settle(corpus.expanded, "expanded"), distributions)
    return located.select(*FILE_KEY, "check_id", "start_line", "inspector_url", "error")


@query(
    "join_cache_exact",
    f"""WITH {FINDINGS}, {CACHED}
SELECT identity, EXISTS (SELECT 1 FROM cached c WHERE c.size = targets.size AND c.ext IS NOT DISTINCT FROM targets.ext
  AND c.content = targets.content) AS hit FROM targets""",
)
def join_cache_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files of an earlier run, whole: bytes decide what is a hit."""
    corpus = Corpus(spark, sf_dir)
    earlier, _ = stored_files(corpus.files.join(corpus.cached.select(*FILE_KEY), FILE_KEY, "left_semi"), corpus.cached)
    entries = corpus.known.withColumn("result", F.lit("[]"))
    hits = exact_hits(corpus.targets, earlier.contents, entries)
    return corpus.identities.join(hits, "identity", "left").select("identity", F.col("result").isNotNull().alias("hit"))


@query(
    "join_cache_split",
    f"""WITH {FINDINGS}, {CACHED},
hits AS (SELECT identity, identity IN (SELECT identity FROM cached) AS candidate FROM targets),
numbered AS (SELECT *, CASE WHEN candidate THEN row_number() OVER (PARTITION BY candidate ORDER BY identity) END AS hit_no FROM hits)
SELECT 'off' AS mode, identity, FALSE AS candidate, NULL AS hit_no, FALSE AS reused FROM numbered
UNION ALL SELECT 'observe', identity, candidate, NULL, FALSE FROM numbered
UNION ALL SELECT 'reuse', identity, candidate, hit_no, candidate AND hit_no % 100 <> 0 FROM numbered""",
)
def join_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = Corpus(spark, sf_dir)
    known = corpus.known.withColumn("result", F.lit("[]"))
    looked_up = corpus.identities.select("identity").join(known, "identity", "left")
    parts = [
        decide(looked_up, mode, [F.col("identity")]).select(
            F.lit(mode).alias("mode"), "identity", "candidate", "hit_no", "reused"
        )
        for mode in ("off", "observe", "reuse")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "join_scanned_semi",
    f"WITH {FINDINGS} SELECT identity, size FROM targets WHERE ext IN ('py', 'pyi', 'js', 'jsx', 'mjs', 'cjs')",
)
def join_scanned_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending targets that the matcher reports as scanned."""
    pending = Corpus(spark, sf_dir).identities
    scanned = scanned_targets(pending, rules(spark, languages=True)).select("identity")
    return pending.join(scanned, "identity", "left_semi").select("identity", "size")


_LIST = "coalesce(string_agg(check_id || '@' || start_line, ',' ORDER BY check_id, start_line), '')"


def _joined(items):
    label = lambda i: F.concat(i["check_id"], F.lit("@"), i["start_line"].cast("string"))
    return F.array_join(F.transform(items, label), ",")


@query(
    "join_findings_left",
    f"""WITH {FINDINGS}
SELECT identity, CAST(count(check_id) AS INTEGER) AS findings, {_LIST} AS items
FROM targets LEFT JOIN findings USING (identity) GROUP BY identity""",
)
def join_findings_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = Corpus(spark, sf_dir)
    pending = corpus.identities.select("identity")
    lists = gather_findings(corpus.findings, ["identity"], ["check_id", "start_line"], limit=None)
    item = "array<struct<check_id:string,start_line:bigint>>"
    joined = pending.join(lists, "identity", "left").withColumn(
        "items", F.when(F.col("over_limit").isNull(), F.array().cast(item)).otherwise(F.col("items"))
    )
    return joined.select("identity", F.size("items").alias("findings"), _joined(F.col("items")).alias("items"))


@query(
    "join_key_fanback",
    f"""WITH {INDEX}, {CACHED},
local_keys AS (
  SELECT DISTINCT sha256, ext FROM index UNION SELECT DISTINCT sha256, '' FROM index WHERE ext IS NULL),
replies AS (SELECT sha256, coalesce(ext, '') AS language, max(doc_id) AS doc_id FROM cached GROUP BY 1, 2)
SELECT l.sha256, l.ext, r.doc_id AS reply FROM local_keys l JOIN replies r
  ON l.sha256 = r.sha256 AND coalesce(l.ext, '') = r.language""",
)
def join_key_fanback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No and empty extension share one stored row; both get its reply."""
    corpus = Corpus(spark, sf_dir)
    index = corpus.identities.select("sha256", "ext")
    empty = index.where("ext IS NULL").withColumn("ext", F.lit(""))
    local = with_durable_key(index.unionByName(empty))
    replies = with_durable_key(corpus.cached).withColumn("result", F.col("doc_id"))
    return fan_back(local, latest_reply(replies, "doc_id"), KEY).select("sha256", "ext", F.col("result").alias("reply"))


# -- set operations ------------------------------------------------------------------


def _reused_and_fresh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of stored targets, and of the targets that are scanned now."""
    corpus = Corpus(spark, sf_dir)
    return corpus.fresh_of_known, corpus.findings.join(corpus.known, "identity", "left_anti")


@query("set_union_findings", f"WITH {FINDINGS} SELECT identity, check_id, start_line FROM findings")
def set_union_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    reused, fresh = _reused_and_fresh(spark, sf_dir)
    return reused.unionByName(fresh).select("identity", "check_id", "start_line")


@query(
    "set_scanned_paths",
    f"WITH {INDEX} SELECT DISTINCT pkg, path FROM index WHERE ext IN ('py', 'js')",
)
def set_scanned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths of the scanned files, per package."""
    scanned = scanned_targets(Corpus(spark, sf_dir).index, rules(spark, languages=True))
    return scanned.select("pkg", "path").distinct()


STORED = f"""{FINDINGS}, {CACHED},
known AS (SELECT identity, max(toxic) AS poisoned FROM cached GROUP BY identity),
stored AS (SELECT f.* FROM findings f JOIN known USING (identity) WHERE poisoned = 0)"""


@query(
    "set_result_diff",
    f"""WITH {STORED}
SELECT 'new' AS side, identity, check_id, start_line FROM findings JOIN known USING (identity) WHERE poisoned = 1""",
)
def set_result_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["identity", "check_id", "start_line"]
    corpus = Corpus(spark, sf_dir)
    old, new = corpus.stored.select(*columns), corpus.fresh_of_known.select(*columns)
    return (
        old.exceptAll(new)
        .withColumn("side", F.lit("old"))
        .unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))
    )


@query(
    "sort_rules",
    """SELECT 'rules/' || item_id || '.yml' AS path, text AS contents,
  row_number() OVER (ORDER BY 'rules/' || item_id || '.yml') AS position FROM benchmark""",
)
def sort_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule files in byte order of their names."""
    named = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("rules/"), F.col("item_id").cast("string"), F.lit(".yml")).alias("path"),
        F.col("text").alias("contents"),
    )
    return row_numbers(named, [], [F.col("path")], "position").orderBy("path")
