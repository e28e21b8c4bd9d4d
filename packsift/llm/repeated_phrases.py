"""Removal of passages that recur, located by sharded Aho-Corasick automata.

A window is ``window`` consecutive words. Each window picks a seed, the phrase of
``SEED_WORDS`` words in it with the smallest hash, so equal windows pick equal seeds.
Seeds that occur once rule out all windows that picked them, and of the rest only
stretches around a seed are kept, equal ones once. Windows of stretches are counted by hash and seed, which
confirms the recurring ones. Neighbouring recurring windows that occur at exactly the same
places are one passage. Passages are compiled into automata, as many
as it takes to bound the size of each, and the stretches of all documents stream through the
automata of their seeds; the words of every match, compared as text, are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.llm.keyfilter import DEFAULT_LOG2_BITS, KeyFilter, key_filter
from packsift.llm.tables import pick, row_hashes, settle
from packsift.llm.textbytes import Splitter, grams, inside, slices, text_buffer

WINDOW = 35
SEED_WORDS = 8
#: Mean number of passages in one automaton and of stretches in one group of a shard.
PASSAGES, STRETCHES = 4096, 8192


#: Stretches whose words a task remembers to have given.
REMEMBERED = 300_000
_LONG = (1 << 64) - 1
#: Bits that count the windows of a stretch; a window has at most so many before its seed.
_AT_BITS = 10
_AT = (1 << _AT_BITS) - 1


class Seeder:
    """Words, window seeds and window hashes of documents."""

    def __init__(self, window: int):
        if window > _AT:
            raise ValueError(f"a window has at most {_AT} words")
        self.window = window
        self.splitter = Splitter()

    def slices(self, column: pa.Array):
        data, offs = text_buffer(column)
        for a, b in slices(offs):
            part = offs[a : b + 1] - offs[a]
            raw = data[offs[a] : offs[b]]
            yield a, b, self.splitter.split(raw, part)

    def seeds(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, place, key)`` of every window: its first word, and the first word and the hash
        of its seed."""
        hashed = self.splitter.hashes(words)
        k = min(SEED_WORDS, self.window)
        phrase = grams(hashed, k, seed=3)
        n, span = len(phrase), self.window - k + 1
        starts = np.flatnonzero(inside(words.first, self.window)) if n else np.zeros(0, np.int64)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint64)
        # The smallest of span hashes from each place, and the first place that has it.
        best, at = phrase.copy(), np.arange(n)
        done = 1
        while done < span:
            step = min(done, span - done)
            later = np.full(n, np.iinfo(np.uint64).max, np.uint64)
            later_at = at.copy()
            later[: n - step] = best[step:]
            later_at[: n - step] = at[step:]
            take = later < best
            best = np.where(take, later, best)
            at = np.where(take, later_at, at)
            done += step
        return starts, at[starts], best[starts]


def _seed_keys(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder(window)
        for batch in batches:
            for _, _, words in seeder.slices(batch.column(0)):
                _, place, key = seeder.seeds(words)
                fresh = np.ones(len(place), bool)
                fresh[1:] = place[1:] != place[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(key[fresh].view(np.int64))], names=["key"])

    return run


def _stretches(window: int, shared: KeyFilter):
    """One row per seed that may recur: the words from its first window to its last, named
    by two hashes. A task gives the words of a stretch once, as long as it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seeder = Seeder(window)
        known: set[int] = set()
        for batch in batches:
            for a, _, words in seeder.slices(batch.column(2)):
                start, place, key = seeder.seeds(words)
                new = np.ones(len(place), bool)
                new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(place)) - 1 if len(heads) else heads
                passed = shared.passes(key[heads]) if len(heads) else np.zeros(0, bool)
                heads, tails = heads[passed], tails[passed]
                doc = np.searchsorted(words.first, start[heads], "right") - 1 if len(heads) else np.zeros(0, np.int64)
                raw = words.data.tobytes()
                s, e = words.start.tolist(), words.end.tolist()
                names, texts = [], []
                for x, y in zip(start[heads].tolist(), start[tails].tolist(), strict=True):
                    text = b" ".join([raw[s[i] : e[i]] for i in range(x, y + window)])
                    name = xxhash.xxh3_128_intdigest(text)
                    names.append((name & _LONG, name >> 64))
                    if name in known:
                        texts.append(None)
                        continue
                    texts.append(text)
                    if len(known) < REMEMBERED:
                        known.add(name)
                rows = pa.array(doc + a, pa.int64())
                two = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start[heads] - words.first[doc]).astype(np.int64)),
                        pa.array(key[heads].view(np.int64)), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(texts, pa.binary()),
                    ],
                    names=["r1", "r2", "first", "seed", "s1", "s2", "words"],
                )

    return run


def _windows(window: int):
    """Hashes of the windows of each stretch ``(seed, s1, n, words)``; the last bits of ``at`` count
    the window from the start of its stretch, the others name the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder(window)
        for batch in batches:
            names = batch.column(1).to_numpy()
            for a, b, words in seeder.slices(batch.column(3).cast(pa.string())):
                found = grams(seeder.splitter.hashes(words), window, seed=5)[inside(words.first, window)]
                counts = np.maximum(words.per_doc - window + 1, 0)
                rows = np.repeat(np.arange(a, b), counts)
                at = np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(found.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take), pa.array((names[rows] & ~_AT) | at)],
                    names=["seed", "h", "s1", "n", "at"],
                )

    return run


def _cut_passages(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for words, lo, hi in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(b" ".join(words.split(b" ")[lo : hi + window]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["seed", "passage"])

    return run


def _symbols(words: list[bytes]) -> str:
    """One character for each word, by its hash; unequal words may share one, so
    matches are compared as text."""
    import xxhash

    return "".join([chr(0x10000 + xxhash.xxh3_64_intdigest(w) % 0x100000) for w in words])


def _locate(passages: pd.DataFrame, stretches: pd.DataFrame) -> pd.DataFrame:
    import ahocorasick

    found: list[tuple[int, int, int, int]] = []
    if len(passages) and len(stretches):
        automaton = ahocorasick.Automaton()
        texts: dict[str, set[bytes]] = {}
        for passage in passages["passage"]:
            texts.setdefault(_symbols(passage.split(b" ")), set()).add(passage)
        for symbols in texts:
            automaton.add_word(symbols, symbols)
        automaton.make_automaton()
        for s1, s2, raw in zip(stretches["s1"], stretches["s2"], stretches["words"], strict=True):
            words = raw.split(b" ")
            ranges: list[list[int]] = []
            for last, symbols in automaton.iter(_symbols(words)):
                lo = last + 1 - len(symbols)
                if b" ".join(words[lo : last + 1]) in texts[symbols]:
                    ranges.append([lo, last + 1])
            ranges.sort()
            merged: list[list[int]] = []
            for lo, hi in ranges:
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            found += [(s1, s2, lo, hi) for lo, hi in merged]
    return pd.DataFrame(found, columns=["s1", "s2", "lo", "hi"]).astype("int64")


def recurring_ranges(docs: DataFrame, window: int, log2_filter_bits: int = DEFAULT_LOG2_BITS) -> DataFrame:
    """``(r1, r2, lo, hi)``: ranges of words covered by recurring windows, of rows
    ``(r1, r2, text)``; a range may come in overlapping parts."""
    counted = docs.select("text").mapInArrow(_seed_keys(window), "key long").groupBy("key").count()
    shared = key_filter(counted.where(F.col("count") > 1), "key", log2_filter_bits)
    stretches = settle(
        docs.select("r1", "r2", "text").mapInArrow(
            _stretches(window, shared), "r1 long, r2 long, first long, seed long, s1 long, s2 long, words binary"
        ),
        "stretches",
    )
    # Equal stretches are one from here on, with the number of places that hold it.
    distinct = settle(
        stretches.groupBy("seed", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.first("words", ignorenulls=True).alias("words")), "distinct"
    )
    kinds = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
    recurring_seeds = kinds.where(F.col("all") > 1)
    alone = recurring_seeds.where(F.col("kinds") == 1).select("seed")
    # A seed with one kind of stretch recurs as a whole. Else the windows tell what recurs.
    same = distinct.join(alone, "seed", "left_semi").select("seed", F.col("words").alias("passage"))
    mixed = distinct.join(recurring_seeds.where(F.col("kinds") > 1).select("seed"), "seed", "left_semi")
    each = mixed.select("seed", "s1", "n", "words").mapInArrow(_windows(window), "seed long, h long, s1 long, n long, at long")
    # A window stands in a stretch once at most, so the xor of the hashes of its stretches stands
    # for the set of them; the least of ``at`` is one of its places.
    recurring = (
        each.groupBy("seed", "h").agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("s1")).alias("where"), F.min("at").alias("at")).where(F.col("n") > 1)
    )
    inner = F.col("at").bitwiseAND(F.lit(_AT))
    runs = recurring.groupBy("seed", F.shiftright("at", _AT_BITS).alias("owner"), "n", "where").agg(F.min(inner).alias("lo"), F.max(inner).alias("hi"))
    owners = mixed.select("seed", F.shiftright("s1", _AT_BITS).alias("owner"), "words")
    cut = runs.join(owners, ["seed", "owner"]).select("seed", "words", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
    passages = settle(same.unionByName(cut.mapInArrow(_cut_passages(window), "seed long, passage binary")), "passages")

    shards = max(1, -(-passages.count() // PASSAGES))
    # A stretch of a seed without a passage has nothing to find.
    live = distinct.join(passages.select("seed").distinct(), "seed", "left_semi")
    shard = F.pmod(F.xxhash64("seed"), F.lit(shards)).cast("int")
    # A shard with more stretches than a group should hold is dealt to several groups, each of
    # which compiles its automaton.
    sizes = live.groupBy(shard.alias("shard")).count().select("shard", F.ceil(F.col("count") / STRETCHES).cast("int").alias("groups"))
    compiled = passages.withColumn("shard", shard).join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = live.withColumn("shard", shard).join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("s1", "s2"), F.col("groups")).cast("int"))
    located = (
        compiled.select("shard", "part", "passage")
        .groupBy("shard", "part")
        .cogroup(dealt.select("shard", "part", "s1", "s2", "words").groupBy("shard", "part"))
        .applyInPandas(_locate, "s1 long, s2 long, lo long, hi long")
    )
    # Back to all places of a stretch.
    return (
        stretches.select("r1", "r2", "first", "s1", "s2")
        .join(located, ["s1", "s2"])
        .select("r1", "r2", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, text, lo array, hi array)`` -> what is left of each text."""
    splitter = Splitter()
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        los, his = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for a, b in slices(offs):
            part = offs[a : b + 1] - offs[a]
            words = splitter.split(data[offs[a] : offs[b]], part)
            raw = words.data.tobytes()
            texts, gone = [], []
            for d in range(b - a):
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                keep = np.ones(hi - lo, bool)
                for x, y in zip(los[a + d] or [], his[a + d] or [], strict=True):
                    keep[x:y] = False
                at = np.flatnonzero(keep) + lo
                texts.append(b" ".join([raw[x:y] for x, y in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]))
                gone.append(hi - lo - len(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(words.per_doc, pa.int64()), pa.array(gone, pa.int64()), pa.array([t.decode() for t in texts], pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )


def _by_touch(touched: KeyFilter, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(touched.passes(batch.column(0).to_numpy()) == wanted))

    return run


def remove_recurring(
    docs: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    log2_filter_bits: int = DEFAULT_LOG2_BITS,
) -> DataFrame:
    """``(id_column, n_words, n_removed, kept)`` for every row of ``docs``.

    Words are runs of characters other than space, tab, line feed, vertical tab, form
    feed and carriage return. A word is removed when a window over it has a sequence of
    words that also starts anywhere else, in another document or the same one. ``kept`` joins
    the other words by one space. Repeated rows are occurrences like any, so they remove each other. A
    null or empty text has no words; fewer words than a window are all kept. Null ids are rows
    like others.
    """
    rows = pick(docs, id=id_column, text=text_column).withColumns(dict(zip(("r1", "r2"), row_hashes("id", "text"), strict=True)))
    kind = rows.schema["id"].dataType.simpleString()
    ranges = settle(recurring_ranges(rows, window, log2_filter_bits), "ranges")
    touched = key_filter(ranges, "r1", log2_filter_bits)
    lists = ranges.groupBy("r1", "r2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    # Only texts that may have lost words meet the ranges; the others stay where they are.
    flagged = rows.select("r1", "r2", "id", "text")
    fields = f"r1 long, r2 long, id {kind}, text string"
    clean = flagged.mapInArrow(_by_touch(touched, False), fields).select("id", "text", *[F.lit(None).cast("array<long>").alias(c) for c in ("lo", "hi")])
    hit = flagged.mapInArrow(_by_touch(touched, True), fields).join(lists, ["r1", "r2"], "left").select("id", "text", "ranges.lo", "ranges.hi")
    return clean.unionByName(hit).mapInArrow(_kept, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_column)
