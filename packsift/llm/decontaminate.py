"""Benchmark items in documents, up to edits, by CGK embedding and bit sampling.

The CGK embedding walks a random path over a sequence: at each step it writes the symbol
under its pointer, and a random bit of (step, symbol) says whether the pointer moves on. Two
sequences of small edit distance give outputs of small Hamming distance with constant
probability, so the walk is repeated. Some coordinates of each output, sampled at random, are
a key, and so are the window's words themselves, which no exact copy can miss; windows of
documents meet windows of items that share a key, and an exact edit distance decides.

Symbols are words (runs of ASCII letters and digits in lower case and of characters
beyond ASCII). Windows are as long as the item from an anchor on, in classes of length. An
anchor is the longest word of some four neighbours (ties by hash), so a passage has
anchors of its own wherever it stands, and a window of a document whose anchor is no
item's anchor need not be embedded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.llm.keyfilter import DEFAULT_LOG2_BITS, KeyFilter, key_filter
from packsift.llm.tables import fresh, pick, row_hashes, settle
from packsift.llm.textbytes import Splitter, slices, splitmix, text_buffer

#: Items with fewer words are no evidence of contamination and take no part.
MIN_WORDS = 8
#: Edits (inserted, deleted, replaced words) per word of an item that still count.
EDIT_RATE = 0.2
NEIGHBOURS = 4
#: Lengths of windows. The first anchor of an item is one of its first NEIGHBOURS words, so the
#: shortest window fits behind it in every item that takes part.
BANDS = (MIN_WORDS - NEIGHBOURS + 1, 6, 9, 13, 19, 28, 42, 63, 95)
WALKS = 4
SAMPLED = 4
#: Chance that one key of a window with edits agrees, and the recall asked for; they give the
#: number of keys: 1 - (1 - HIT)^keys >= RECALL.
HIT, RECALL = 0.25, 0.95
SEED = 7

# ASCII characters that are no letter or digit separate words.
_MARKS = tuple(c for c in range(128) if not chr(c).isalnum())


def keys_per_walk() -> int:
    return -(-math.ceil(math.log(1 - RECALL) / math.log(1 - HIT)) // WALKS)


def sampled_steps() -> dict[int, np.ndarray]:
    """For each band the steps of each key, walks x keys x samples. Step 0 is the anchor, which
    agrees already; the last steps would read past the window."""
    rng = np.random.default_rng(SEED)
    return {
        w: np.sort(np.stack([np.stack([rng.choice(np.arange(1, int(1.6 * w)), SAMPLED, replace=False) for _ in range(keys_per_walk())]) for _ in range(WALKS)]), axis=2)
        for w in BANDS[1:] + BANDS[:1]
    }


class Embedder:
    def __init__(self):
        self.splitter = Splitter(lower=True, extra=_MARKS, seed=SEED)
        self.steps = sampled_steps()
        # An odd multiplier per walk and step is the random function of the symbol.
        n = WALKS * 2 * max(BANDS)
        self.odd = (splitmix(np.arange(n, dtype=np.uint64) + np.uint64(SEED << 20)) | np.uint64(1)).reshape(WALKS, -1)

    def anchors(self, hashed: np.ndarray, words) -> np.ndarray:
        """Places of anchors; a document of fewer than ``NEIGHBOURS`` words has none."""
        n = len(hashed)
        if n < NEIGHBOURS:
            return np.zeros(0, np.int64)
        length = np.minimum(words.end - words.start, 15).astype(np.uint64)
        rank = ((np.uint64(15) - length) << np.uint64(60)) | (hashed >> np.uint64(4))
        m = n - NEIGHBOURS + 1
        least, at = rank[:m].copy(), np.arange(m)
        for j in range(1, NEIGHBOURS):
            less = rank[j : j + m] < least
            least[less] = rank[j : j + m][less]
            at[less] = np.flatnonzero(less) + j
        ends = np.repeat(words.first[1:], words.per_doc)
        return np.unique(at[np.arange(m) + NEIGHBOURS <= ends[:m]])

    def keys(self, hashed: np.ndarray, places: np.ndarray, ends: np.ndarray, bands: list[int]) -> dict[int, np.ndarray]:
        """For each band the keys of the windows at ``places`` (rows), one column per walk and
        key, and one for the window's words. Beyond ``ends`` a window reads a mark of its own."""
        padded = np.append(hashed, np.uint64(0))
        out = {w: np.zeros((len(places), WALKS * keys_per_walk()), np.uint64) for w in bands}
        with np.errstate(over="ignore"):
            for walk in range(WALKS):
                wanted: dict[int, list[tuple[int, int]]] = {}
                for w in bands:
                    for k, steps in enumerate(self.steps[w][walk]):
                        for t in steps.tolist():
                            wanted.setdefault(t, []).append((w, walk * keys_per_walk() + k))
                at = places.copy()
                first = padded[at]
                for w in bands:
                    out[w][:, walk * keys_per_walk() : (walk + 1) * keys_per_walk()] = first[:, None]
                for t in range(max(wanted, default=-1) + 1):
                    symbol = np.where(at < ends, padded[np.minimum(at, ends)], np.uint64(0))
                    for w, column in wanted.get(t, ()):
                        out[w][:, column] = out[w][:, column] * np.uint64(0x9E3779B97F4A7C15) + symbol
                    at = at + ((symbol * self.odd[walk, t]) >> np.uint64(63)).astype(np.int64)
            for w in bands:
                mark = splitmix(np.arange(WALKS * keys_per_walk(), dtype=np.uint64) + np.uint64(w << 32))
                out[w] = splitmix(out[w] ^ mark)
            words = np.zeros(len(places), np.uint64)
            for j in range(max(bands, default=0)):
                at = places + j
                words = words * np.uint64(0x9E3779B97F4A7C15) + np.where(at < ends, padded[np.minimum(at, ends)], np.uint64(0))
                if j + 1 in out:
                    own = splitmix(words ^ splitmix(np.array([(j + 1 << 32) + WALKS * keys_per_walk()], np.uint64)))
                    out[j + 1] = np.append(out[j + 1], own[:, None], axis=1)
        return out


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    embedder = Embedder()
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        for a, b in slices(offs):
            part = offs[a : b + 1] - offs[a]
            words = embedder.splitter.split(data[offs[a] : offs[b]], part)
            hashed = embedder.splitter.hashes(words)
            places = embedder.anchors(hashed, words)
            doc = np.searchsorted(words.first, places, "right") - 1
            n, off = words.per_doc[doc], places - words.first[doc]
            # From the anchor on, at least half of the item is left.
            use = (n >= MIN_WORDS) & (2 * off <= n) & (n - off >= BANDS[0])
            places, doc, n, off = places[use], doc[use], n[use], off[use]
            band = np.array(BANDS)[np.searchsorted(BANDS, n - off, "right") - 1]
            rows: list[tuple] = []
            for w in np.unique(band).tolist():
                own = np.flatnonzero(band == w)
                keys = embedder.keys(hashed, places[own], words.first[doc[own] + 1], [w])[w].view(np.int64)
                for i, row in zip(own.tolist(), keys.tolist(), strict=True):
                    raw = hashed[words.first[doc[i]] : words.first[doc[i] + 1]].tobytes()
                    rows.append((a + int(doc[i]), int(hashed[places[i]].view(np.int64)), int(off[i]), int(n[i]), w, row, raw))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.binary())],
                names=["item", "anchor", "off", "n", "band", "keys", "words"],
            )


def _document_windows(anchors: KeyFilter, keys: KeyFilter, bands: list[int], reach: int):
    """Windows with a key that an item may have, and the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = Embedder()
        for batch in batches:
            data, offs = text_buffer(batch.column(2))
            for a, b in slices(offs):
                part = offs[a : b + 1] - offs[a]
                words = embedder.splitter.split(data[offs[a] : offs[b]], part)
                hashed = embedder.splitter.hashes(words)
                places = embedder.anchors(hashed, words)
                places = places[anchors.passes(hashed[places])]
                doc = np.searchsorted(words.first, places, "right") - 1
                found = embedder.keys(hashed, places, words.first[doc + 1], bands)
                all_keys = np.concatenate([found[w] for w in bands], axis=1) if bands else np.zeros((len(places), 0), np.uint64)
                passed = keys.passes(all_keys.ravel()).reshape(all_keys.shape)
                rows, lists, at, around = [], [], [], []
                for i in np.flatnonzero(passed.any(axis=1)).tolist():
                    lo, hi = words.first[doc[i]], words.first[doc[i] + 1]
                    left = max(lo, places[i] - reach)
                    rows.append(a + int(doc[i]))
                    lists.append(all_keys[i][passed[i]].view(np.int64).tolist())
                    at.append((int(places[i] - lo), int(places[i] - left)))
                    around.append(hashed[left : min(hi, places[i] + reach)].tobytes())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array([x for x, _ in at], pa.int64()), pa.array([y for _, y in at], pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array(around, pa.binary())],
                    names=["r1", "r2", "place", "inner", "keys", "around"],
                )

    return run


def edit_distance_within(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any stretch of ``text``, and where the first such
    stretch ends, by Myers' bit-parallel recurrence over one big integer."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, symbol in enumerate(text):
        eq = masks.get(symbol, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _verify(edit_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, distances, ends = [], [], []
            columns = [batch.column(i).to_pylist() for i in range(3, 9)]
            for i, (place, inner, off, n, around, item) in enumerate(zip(*columns, strict=True)):
                slack = int(edit_rate * n)
                left = max(0, inner - off - slack)
                near = np.frombuffer(around, np.uint64)[left : inner - off + n + slack]
                distance, end = edit_distance_within(np.frombuffer(item, np.uint64).tolist(), near.tolist())
                if distance <= slack:
                    keep.append(i), distances.append(distance), ends.append(place - inner + left + end)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(take) for i in range(3)], pa.array(distances, pa.int32()), pa.array(ends, pa.int64())], names=["r1", "r2", "item", "distance", "end"]
            )

    return run


def item_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    edit_rate: float = EDIT_RATE,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    log2_filter_bits: int = DEFAULT_LOG2_BITS,
) -> DataFrame:
    """``(r1, r2, item, distance, end)``: items found in a document, with the least edit
    distance in words and the word behind the place it was found at. ``r1, r2`` are hashes of id and
    text of the document's row.
    """
    rows = pick(docs, id=id_column, text=text_column)
    r1, r2 = row_hashes("id", "text")
    items = pick(benchmark, item=item_column, text=item_text_column)
    kind = items.schema["item"].dataType.simpleString()
    windows = settle(
        items.mapInArrow(_item_windows, f"item {kind}, anchor long, off int, n int, band int, keys array<long>, words binary"), "items"
    )
    sizes = windows.groupBy("band").agg(F.max("n").alias("n")).collect()  # at most one row per band
    bands = sorted(r["band"] for r in sizes)
    longest = max((r["n"] for r in sizes), default=0)
    reach = longest + int(edit_rate * longest) + 1
    anchors = key_filter(windows, "anchor", log2_filter_bits)
    by_key = windows.select("item", "off", "n", "words", F.explode("keys").alias("key"))
    keys = key_filter(by_key, "key", log2_filter_bits)
    found = settle(
        rows.select(r1.alias("r1"), r2.alias("r2"), "text").mapInArrow(
            _document_windows(anchors, keys, bands, reach), "r1 long, r2 long, place long, inner int, keys array<long>, around binary"
        ),
        "windows",
    )
    met = found.select("r1", "r2", "place", "inner", "around", F.explode("keys").alias("key")).join(by_key, "key")
    # One look at each place where an item may start.
    pairs = met.withColumn("start", F.col("place") - F.col("off")).dropDuplicates(["r1", "r2", "start", "item"])
    checked = pairs.select("r1", "r2", "item", "place", "inner", "off", "n", "around", "words").mapInArrow(
        _verify(edit_rate), f"r1 long, r2 long, item {kind}, distance int, end long"
    )
    best = checked.groupBy("r1", "r2", "item").agg(F.min(F.struct("distance", "end")).alias("best"))
    return best.select("r1", "r2", "item", "best.distance", "best.end")


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``(id_column, contaminated, items)`` for every row of ``docs``; ``items`` is the sorted
    array of item ids found in it, empty for a clean document.

    A document is contaminated by an item when some stretch of its words is within
    ``edit_rate`` times the item's number of words from the whole item in edit distance. Items of
    fewer than ``MIN_WORDS`` words, null or empty ones take no part. A null or empty
    text is clean, and so is every text when there is no item. Repeated documents are flagged alike; repeated items are found together.
    """
    hits = item_hits(docs, benchmark, id_column=id_column, text_column=text_column, **options)
    lists = hits.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    r1, r2 = row_hashes("id", "text")
    keyed = pick(docs, id=id_column, text=text_column).select("id", r1.alias("r1"), r2.alias("r2"))
    kind = lists.schema["items"].dataType.simpleString()
    return keyed.join(lists, ["r1", "r2"], "left").select(
        F.col("id").alias(id_column), F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(kind)).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns; cases as in ``flag_contaminated``."""
    hits = item_hits(docs, benchmark, id_column=id_column, text_column=text_column, **options)
    r1, r2 = row_hashes(id_column, text_column)
    k1, k2 = fresh(docs, "r1", "r2")
    found = hits.select(F.col("r1").alias(k1), F.col("r2").alias(k2)).distinct()
    return docs.withColumns({k1: r1, k2: r2}).join(found, [k1, k2], "left_anti").select(*docs.columns)
