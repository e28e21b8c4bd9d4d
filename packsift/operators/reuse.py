"""Reuse of earlier results across packages through a keyed result table.

Table rows are (scanner, rules_commit, rules_digest, engine_digest, file_digest,
language, result), with ``result`` the JSON list of findings of that content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packsift.functions.identity import durable_language
from packsift.operators.running import row_numbers, running_totals
from packsift.operators.skew import skew_safe_join
from packsift.schemas import FINDING, NAMESPACE, required_item
from packsift.session import settle
from packsift.settings import (
    AUDIT_EVERY,
    CACHE_BYTES,
    CACHE_ENTRIES,
    MAX_BROADCAST_ROWS,
    MAX_CACHE_RESULT_BYTES,
)

KEY = ["file_digest", "language"]
MODES = ("off", "observe", "reuse")
COUNTERS = [
    "lookups",
    "candidate_files",
    "reused_files",
    "reused_bytes",
    "inserted_files",
    "evicted_files",
    "errors",
    "validated_files",
    "mismatched_files",
    "engine_files",
    "engine_bytes",
]


# -- keys and lookups ----------------------------------------------------------------


def with_durable_key(rows: DataFrame) -> DataFrame:
    """Add the shared key. No extension and an empty one meet in it; files with
    an over-long extension take no part in sharing."""
    keyed = rows.withColumns({"file_digest": F.col("sha256"), "language": durable_language(F.col("ext"))})
    return keyed.where(F.col("language").isNotNull())


def lookup(keys: DataFrame, cache: DataFrame, on: Sequence[str] = (*NAMESPACE, *KEY)) -> DataFrame:
    """Distinct keys with their stored result, NULL for a miss.

    Keys are made distinct first, so a file found in every package is looked up
    once and both sides of the join have unique keys.
    """
    return keys.select(*on).distinct().join(cache.select(*on, "result"), list(on), "left")


def latest_reply(replies: DataFrame, order: str, key: Sequence[str] = KEY) -> DataFrame:
    """One reply per key; the last one wins."""
    return replies.groupBy(*key).agg(F.max_by("result", order).alias("result"))


def fan_back(local: DataFrame, replies: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Give each local key its reply; several local keys may share one.

    Local keys are distinct identities, so only a few meet in one stored row.
    """
    return local.join(replies, list(key))


def decode(result: Column) -> Column:
    """Findings of a stored result, NULL where it cannot be decoded in full."""
    findings = F.from_json(result, T.ArrayType(FINDING))
    complete = F.forall(findings, lambda item: required_item(item, FINDING))
    return F.when(F.coalesce(complete, F.lit(False)), findings)


def exact_hits(contents: DataFrame, stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries ``(identity, result)`` whose stored bytes are those of the content.

    ``contents`` and ``stored`` are clustered by identity (content stores with equally
    many buckets). Candidates are found on narrow rows, the identity holding the hash;
    only their bytes are compared, bucket by bucket, and no content is moved: ``coalesce``
    keeps the comparison from becoming a key of the join.
    """
    candidates = entries.join(contents.select("identity"), "identity", "left_semi").hint("shuffle_hash")
    ours = contents.join(candidates.select("identity").hint("shuffle_hash"), "identity", "left_semi").select("identity", "content")
    theirs = stored.join(candidates, "identity").select("identity", F.col("content").alias("_c"), "result").hint("merge")
    equal = F.coalesce(F.col("content") == F.col("_c"), F.lit(False))
    return ours.join(theirs, "identity").where(equal).select("identity", "result")


def without_revoked(rows: DataFrame, revocations: DataFrame) -> DataFrame:
    """Leave out rows whose namespace was revoked; applies to reads and writes.

    One namespace usually holds most rows: revocations are broadcast while they
    are few, and joined with salts beyond that.
    """
    revoked = revocations.select(*NAMESPACE).distinct()
    if revoked.count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(revoked), NAMESPACE, "left_anti")
    return skew_safe_join(rows, revoked, NAMESPACE, "left_anti")


# -- which hits are reused -----------------------------------------------------------


def audit_hits(
    hits: DataFrame, namespace: Sequence[str], order: Sequence[Column], every: int = AUDIT_EVERY
) -> DataFrame:
    """Number hits per namespace; every ``every``-th is rescanned, not reused."""
    numbered = row_numbers(hits, namespace, order, "hit_no")
    return numbered.withColumn("reused", F.col("hit_no") % every != 0)


def decide(
    targets: DataFrame,
    mode: str,
    order: Sequence[Column],
    every: int = AUDIT_EVERY,
    namespace: Sequence[str] = (),
) -> DataFrame:
    """Split targets into reused and pending.

    ``targets`` has a ``result`` column (NULL for no stored result). Adds
    ``lookups``, ``candidate``, ``hit_no`` and ``reused``; what is not reused has
    to be scanned. Hits are numbered along ``order`` within a namespace.
    """
    if mode not in MODES:
        raise ValueError(f"unknown cache mode {mode!r}")
    looked_up = F.lit(0 if mode == "off" else 1).cast("bigint")
    candidate = F.lit(mode != "off") & F.col("result").isNotNull()
    rows = targets.withColumns({"lookups": looked_up, "candidate": candidate})
    if mode != "reuse":
        return rows.withColumns({"hit_no": F.lit(None).cast("bigint"), "reused": F.lit(False)})
    # Only candidates are numbered; the others stay where they are.
    rows = settle(rows, "looked-up")
    numbered = row_numbers(rows.where("candidate"), namespace, order, "hit_no").withColumn("reused", F.col("hit_no") % every != 0)
    others = rows.where("NOT candidate").withColumns({"hit_no": F.lit(None).cast("bigint"), "reused": F.lit(False)})
    return numbered.unionByName(others)


# -- comparing and storing -----------------------------------------------------------


def differing_findings(
    old: DataFrame, new: DataFrame, key: Sequence[str], item: Sequence[str]
) -> DataFrame:
    """Findings whose number of occurrences differs, per key.

    A signed count per finding; nothing is collected, so a target with very many
    findings stays distributed.
    """
    columns = [*key, *item]
    signed = old.select(*columns, F.lit(-1).alias("_sign")).unionByName(
        new.select(*columns, F.lit(1).alias("_sign"))
    )
    return signed.groupBy(*columns).agg(F.sum("_sign").alias("difference")).where("difference <> 0")


def mismatched_keys(
    old: DataFrame, new: DataFrame, key: Sequence[str], item: Sequence[str]
) -> DataFrame:
    """Keys whose old and new findings are not equal as multisets."""
    return differing_findings(old, new, key, item).select(*key).distinct()


def fifo_retention(
    entries: DataFrame,
    group: Sequence[str],
    seq: str,
    size: str,
    max_entries: int = CACHE_ENTRIES,
    max_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """Which entries a first-in-first-out table of bounded size still holds.

    For unique keys that is the longest suffix in insertion order within both
    bounds. Entries larger than the table are never stored and left out.
    """
    stored = entries.where(F.col(size) <= max_bytes)
    suffix = running_totals(
        stored, group, [F.col(seq).desc()], {"_n": F.lit(1), "_bytes": F.col(size)}
    )
    retained = (F.col("_n") <= max_entries) & (F.col("_bytes") <= max_bytes)
    return suffix.withColumn("retained", retained).drop("_n", "_bytes")


def storable(results: DataFrame, limit: int = MAX_CACHE_RESULT_BYTES) -> DataFrame:
    """Results small enough for the shared table."""
    return results.where(F.octet_length("result") <= limit)


def new_entries(
    fresh: DataFrame, cache: DataFrame, order: Sequence[str], on: Sequence[str] = (*NAMESPACE, *KEY)
) -> DataFrame:
    """Rows to append: first result per key, and no key that is already stored."""
    payload = [name for name in fresh.columns if name not in on]
    first = fresh.groupBy(*on).agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("_row")
    ).select(*on, "_row.*")
    return first.join(cache.select(*on).distinct(), list(on), "left_anti")


def admit(
    results: DataFrame,
    warnings: DataFrame,
    cache: DataFrame,
    order: Sequence[str],
    job: str = "pkg",
    on: Sequence[str] = KEY,
    weights: DataFrame | None = None,
) -> DataFrame:
    """New table rows from complete runs only.

    ``results`` holds one row per scanned (job, target), clean ones included. A
    job with any warning admits nothing. ``weights`` as in the salted join.
    """
    complete = skew_safe_join(results, warnings.select(job).distinct(), [job], "left_anti", weights=weights)
    return new_entries(storable(complete), cache, order, on)


def counters(decisions: DataFrame, evictions: DataFrame, job: str = "pkg") -> DataFrame:
    """Work counters per job from target decisions.

    Expects lookups, candidate, reused, size, decode_error, validated, mismatched and
    inserted on every target row, and rows (job, evicted_files) for jobs whose new results
    pushed old ones out.
    """
    flag = lambda name: F.count_if(F.col(name))
    pending = ~F.col("reused")
    size_if = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("size"))), F.lit(0))
    counted = decisions.groupBy(job).agg(
        F.sum("lookups").alias("lookups"),
        flag("candidate").alias("candidate_files"),
        flag("reused").alias("reused_files"),
        size_if(F.col("reused")).alias("reused_bytes"),
        flag("inserted").alias("inserted_files"),
        flag("decode_error").alias("errors"),
        flag("validated").alias("validated_files"),
        flag("mismatched").alias("mismatched_files"),
        F.count_if(pending).alias("engine_files"),
        size_if(pending).alias("engine_bytes"),
    )
    evicted = F.coalesce("evicted_files", F.lit(0).cast("bigint")).alias("evicted_files")
    return counted.join(evictions, job, "left").select(job, *[evicted if c == "evicted_files" else F.col(c) for c in COUNTERS])


def evictions(stored: DataFrame, inserted: DataFrame, max_entries: int = CACHE_ENTRIES, max_bytes: int = CACHE_BYTES, job: str = "pkg") -> tuple[DataFrame, DataFrame]:
    """What a first-in-first-out bound on the table pushes out, entry after entry.

    ``stored`` has (key columns, seq, size), ``inserted`` the same and the job that stores
    each, all later in ``seq``; none is larger than the bound. Returns rows (job, evicted_files),
    and the key columns of all that goes. What went after a job's last entry are the entries
    that the running numbers up to there leave no room for: a count by number, and a rank
    among the running sizes, so no entry is ever compared with another.
    """
    columns = [c for c in inserted.columns if c != job]
    rows = stored.select(*columns, F.lit(None).cast(inserted.schema[job].dataType).alias(job)).unionByName(inserted.select(*columns, job))
    placed = settle(running_totals(rows, [], [F.col("seq")], {"_n": F.lit(1), "_b": F.col("size")}), "placed")
    ends = placed.where(F.col(job).isNotNull()).groupBy(job).agg(F.max("_n").alias("_n"), F.max("_b").alias("_b"))
    by_size = placed.select((F.col("_b") - F.col("size")).alias("_at"), F.lit(1).alias("_one"), F.lit(None).cast(inserted.schema[job].dataType).alias(job), F.col("_n"))
    asked = ends.select((F.col("_b") - max_bytes).alias("_at"), F.lit(0).alias("_one"), job, "_n")
    ranked = running_totals(by_size.unionByName(asked), [], [F.col("_at"), F.col("_one")], {"_r": F.col("_one")}).where(F.col(job).isNotNull())
    gone = ranked.select(job, F.greatest(F.col("_n") - max_entries, "_r", F.lit(0)).alias("_gone"), "_n")
    numbered = settle(row_numbers(gone, [], [F.col("_n")], "_j"), "gone")
    before = numbered.select((F.col("_j") + 1).alias("_j"), F.col("_gone").alias("_before"))
    per_job = numbered.join(before, "_j", "left").select(job, (F.col("_gone") - F.coalesce("_before", F.lit(0))).cast("bigint").alias("evicted_files"))
    total = numbered.agg(F.coalesce(F.max("_gone"), F.lit(0)).alias("_total"))
    out = placed.join(F.broadcast(total), F.col("_n") <= F.col("_total")).select(*[c for c in columns if c not in ("seq", "size")])
    return per_job, out
