"""Removal of lines that many sites share, with column functions only.

Every line that is not blank is hashed (two 64-bit hashes). A line is shared when it
stands on enough distinct sites and in enough distinct texts; the second keeps copies of
one whole text from turning their own lines into boilerplate. Both are counted over all
documents by HyperLogLog sketches that merge in the aggregation. Lines with an estimate
within the sketch's error of the threshold get exact distinct counts; the others are
decided by the estimates. Only positions of removed lines meet the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.functions.binding import let
from packsift.llm.tables import fresh, row_hashes, settle, two_hashes
from packsift.operators.skew import skew_safe_join
from packsift.settings import MAX_BROADCAST_ROWS

MIN_SITES = 10
LOG2_BUCKETS = 10
#: Relative standard errors of the sketch on either side of the threshold that are
#: counted exactly. HyperLogLog: 1.04 / sqrt(buckets).
BAND = 6.0


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_spread(docs: DataFrame, text_column: str = "text", site_column: str = "source") -> DataFrame:
    """``(h1, h2, t1, t2, site)``: the lines of all documents with the hashes of their text
    and their site. A null site is a site of its own, ``''``."""
    t1, t2 = two_hashes(F.coalesce(F.col(text_column), F.lit("")))
    rows = docs.select(
        t1.alias("t1"),
        t2.alias("t2"),
        F.coalesce(F.col(site_column).cast("string"), F.lit("")).alias("site"),
        F.explode(text_lines(F.col(text_column))).alias("line"),
    ).where(F.trim("line") != "")
    h1, h2 = two_hashes(F.col("line"))
    return rows.select(h1.alias("h1"), h2.alias("h2"), "t1", "t2", "site")


def boilerplate(spread: DataFrame, min_sites: int = MIN_SITES, log2_buckets: int = LOG2_BUCKETS) -> DataFrame:
    """Hashes ``(h1, h2)`` of lines on at least ``min_sites`` distinct sites and in at least
    as many distinct texts.

    ``spread`` is read twice and should be a written table. Places of a line that is counted
    exactly are made distinct in their tasks first, so a line of very many places moves once
    for each task, site and text.
    """
    sketches = spread.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", log2_buckets).alias("sites"), F.hll_sketch_agg(F.xxhash64("t1", "t2"), log2_buckets).alias("texts")
    )
    least = F.least(F.hll_sketch_estimate("sites"), F.hll_sketch_estimate("texts")).alias("least")
    margin = BAND * 1.04 / (1 << log2_buckets) ** 0.5
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    counted = settle(sketches.select("h1", "h2", least).where(F.col("least") >= low), "estimates")
    near = counted.where(F.col("least") <= high).select("h1", "h2")
    rows = among(spread, near)
    enough = lambda *columns: (
        rows.select("h1", "h2", *columns).distinct().groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    )
    exact = enough("site").join(enough("t1", "t2"), ["h1", "h2"], "left_semi")
    return counted.where(F.col("least") > high).select("h1", "h2").unionByName(exact)


def among(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows ``(h1, h2, ...)`` of the given lines. Few lines go to every task, so the rows stay
    where they are; beyond that rows of a line that has very many are salted."""
    if lines.count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(lines), ["h1", "h2"], "left_semi")
    return skew_safe_join(rows, lines, ["h1", "h2"], "left_semi")


def without_positions(lines: Column, gone: Column) -> Column:
    """``lines`` without the sorted positions ``gone`` (from 0), in one pass: the
    stretches between neighbouring removed positions, joined."""
    stretch = lambda i: F.slice(
        lines,
        F.when(i == 0, 1).otherwise(F.get(gone, i - 1) + 2),
        F.coalesce(F.get(gone, i), F.size(lines)) - F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1),
    )
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), stretch))


def remove_shared_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
    counts: tuple[str, str] | None = ("n_lines", "n_removed"),
) -> DataFrame:
    """All columns of ``docs`` with ``text_column`` cleaned, and under the names ``counts``
    the numbers of lines and of removed lines, in the place of columns of these names.

    A line goes when it stands on at least ``min_sites`` distinct sites and in as many
    distinct texts, counted over all documents.

    A line is what stands between line feeds; lines of white space only are kept and
    never counted. A null text stays null with no lines removed (it counts as one
    empty line); an empty text likewise stays empty. Lines are compared as they are, whole. A
    document all of whose lines are shared keeps its row with an empty text. Repeated
    rows are cleaned alike; an empty table gives an empty table.
    """
    spread = settle(line_spread(docs, text_column, site_column), "lines")
    shared = settle(boilerplate(spread, min_sites), "shared")
    r1, r2 = row_hashes(id_column, text_column)
    places = docs.select(r1.alias("r1"), r2.alias("r2"), F.posexplode(text_lines(F.col(text_column))).alias("at", "line"))
    h1, h2 = two_hashes(F.col("line"))
    places = places.where(F.trim("line") != "").select("r1", "r2", "at", h1.alias("h1"), h2.alias("h2"))
    k1, k2, gone = fresh(docs, "r1", "r2", "gone")
    removed = (
        among(places, shared)
        .groupBy(F.col("r1").alias(k1), F.col("r2").alias(k2))
        .agg(F.sort_array(F.collect_set("at")).alias(gone))
    )
    keyed = docs.withColumns({k1: r1, k2: r2}).join(removed, [k1, k2], "left")
    lines = text_lines(F.col(text_column))
    # The text is split once for all stretches that stay.
    kept = let(lines, lambda whole: F.array_join(without_positions(whole, F.col(gone)), "\n"))
    cleaned = F.when(F.col(gone).isNull(), F.col(text_column)).otherwise(kept)
    numbers = (F.size(lines).cast("long"), F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long"))
    changed = {text_column: cleaned} | (dict(zip(counts, numbers, strict=True)) if counts else {})
    return keyed.withColumns(changed).drop(k1, k2, gone)
