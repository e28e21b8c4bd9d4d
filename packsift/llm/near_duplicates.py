"""Documents joined by the Jaccard similarity of their word shingles.

Equal shingle sets are one class, so copies never meet each other. Every class gives
the shingles of its prefix as keys: the first few in one total order, rare ones first,
of which two sets as similar as asked for must share one. A tile is a key and a size
band; a pair is looked at only in a tile both are in. Signatures are bitmaps of hashed
shingles by parity: the bits in which two differ bound the shingles they do not share from
below, hence the overlap from above. What passes is decided by intersecting the sorted
arrays of shingle hashes.

First each class is compared with one leader of each of its tiles, in a few rounds with other
leaders, which joins groups of near copies with as many comparisons as they have members.
What was joined carries one label, passed on along each round's links.
Then only pairs of different components are looked at, in tiles whose key may be the first that they share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.llm.components import connected
from packsift.llm.keyfilter import DEFAULT_LOG2_BITS, KeyFilter, key_filter
from packsift.llm.tables import fresh, pick, row_hashes, settle
from packsift.llm.textbytes import Splitter, grams, inside, slices, text_buffer, whole

#: Shingles that are frequent in many texts come last in the order. The list only orders, so
#: its bound costs speed at most. A task reports a shingle it met so often among so many.
FREQUENT_SHINGLES = 1 << 16
FREQUENT, STRETCH = 8, 1 << 22
WORDS = 8  # 64-bit words of a signature
_SIGNATURE = [f"s{i}" for i in range(WORDS)]
#: Larger sets carry a finer signature too, of one to two bits for each shingle.
COARSE = 1000
#: Bytes of texts whose shingles are made at a time.
SLICE = 1 << 18
#: Rounds of comparing with leaders before pairs are looked at.
STAR_ROUNDS = 3


class Shingler:
    """Sorted distinct shingle hashes of documents; two independent sums over a set, with
    its size, stand for the set."""

    def __init__(self, k: int):
        self.k, self.splitter = k, Splitter(lower=True)

    def sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first document, hashes, offsets)`` by slice."""
        data, offs = text_buffer(column)
        for a, b in slices(offs, SLICE):
            part = offs[a : b + 1] - offs[a]
            words = self.splitter.split(data[offs[a] : offs[b]], part)
            hashed = self.splitter.hashes(words)
            first, per = words.first, words.per_doc
            valid = inside(first, self.k)
            found = grams(hashed, self.k)[valid]
            counts = np.maximum(per - self.k + 1, 0)
            short = np.flatnonzero((per > 0) & (per < self.k))
            if len(short):
                extra = np.array([whole(hashed[first[d] : first[d + 1]]) for d in short], np.uint64)
                found = np.insert(found, np.concatenate([[0], np.cumsum(counts)])[short], extra)
                counts[short] = 1
            at = np.concatenate([[0], np.cumsum(counts)])
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                found[lo:hi].sort()
            doc = np.repeat(np.arange(b - a), counts)
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
            found, doc = found[fresh], doc[fresh]
            yield a, found, np.searchsorted(doc, np.arange(b - a + 1))


def class_keys(hashes: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, None for the empty one."""
    with np.errstate(over="ignore"):
        other = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        other ^= other >> np.uint64(32)
        sums = np.zeros((len(hashes) + 1, 2), np.uint64)
        np.cumsum(hashes, out=sums[1:, 0])
        np.cumsum(other * other, out=sums[1:, 1])
        two = sums[at[1:]] - sums[at[:-1]]
        two[:, 0] += np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    raw, n = two.tobytes(), np.diff(at)
    return [raw[16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles of a set of ``n`` must meet those of any set it links with."""
    return n - -(-n * percent // 100) + 1


class Order:
    """Shingles by hash, the frequent ones behind all others by their count."""

    def __init__(self, frequent: np.ndarray, rank: np.ndarray):
        self.frequent, self.rank = frequent, rank  # sorted by hash

    def prefix(self, own: np.ndarray, length: int) -> np.ndarray:
        if not len(self.frequent):
            return own[:length]
        at = np.minimum(np.searchsorted(self.frequent, own), len(self.frequent) - 1)
        often = self.frequent[at] == own
        rare = own[~often]
        if len(rare) >= length:
            return rare[:length]
        late = own[often]
        return np.concatenate([rare, late[np.lexsort((late, self.rank[at[often]]))][: length - len(rare)]])


def signature(own: np.ndarray) -> np.ndarray:
    bits = np.bincount((own >> np.uint64(7)).astype(np.int64) & (WORDS * 64 - 1), minlength=WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def fine_signature(own: np.ndarray) -> bytes | None:
    """Parities in a power of two of bits, at least one for each shingle; None for a small set."""
    if len(own) <= COARSE:
        return None
    bits = 1 << (len(own) - 1).bit_length()
    parity = np.bincount((own >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def _fine_bound(percent: int):
    """Pairs ``(a, b, halves, n, m, fine, fine)`` that the finer signatures leave; of unequal
    lengths the longer one is folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*[batch.column(c).to_pylist() for c in (3, 4, 5, 6)], strict=True)):
                one, two = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                while len(two) > len(one):
                    two = two[: len(two) // 2] ^ two[len(two) // 2 :]
                apart = int(np.bitwise_count(one ^ two).sum())
                if 100 * (n + m - apart) >= percent * (n + m + apart):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(take) for i in range(3)], names=["a", "b", "halves"])

    return run


def frequent(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur ``least`` times or more in arrays, which are let go, and how often. Sorted
    in place, so that two copies of all values are the most that is held."""
    found = np.concatenate(held)
    held.clear()
    found.sort()
    values = np.unique(found[least - 1 :][found[least - 1 :] == found[: len(found) - least + 1]]) if len(found) >= least else found[:0]
    return values, np.searchsorted(found, values, "right") - np.searchsorted(found, values, "left")


def _sets_and_frequent(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(k), [], 0

        def report() -> pa.RecordBatch:
            values, counts = frequent(held, FREQUENT)
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(counts, pa.int64()), pa.array(values.view(np.int64))], names=["id", "cls", "n", "shingle"]
            )

        for batch in batches:
            kind = batch.column(0).type
            for a, hashes, at in shingler.sets(batch.column(1)):
                m = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, m), pa.array(class_keys(hashes, at), pa.binary()), pa.array(np.diff(at)), pa.nulls(m, pa.int64())],
                    names=["id", "cls", "n", "shingle"],
                )
                held.append(hashes)
                size += len(hashes)
                if size >= STRETCH:
                    yield report()
                    size = 0
        if held:
            yield report()

    return run


def _prefix_keys(k: int, percent: int, order: Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            for _, hashes, at in shingler.sets(batch.column(0)):
                keys = [order.prefix(hashes[lo:hi], prefix_length(hi - lo, percent)) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if hi > lo]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))], names=["key"])

    return run


def _candidates(k: int, percent: int, order: Order, shared: KeyFilter):
    """Classes with a prefix shingle that is not theirs alone; each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        seen: set[bytes] = set()
        for batch in batches:
            for _, hashes, at in shingler.sets(batch.column(0)):
                rows, keys, places, signs, fine = [], [], [], [], []
                for cls, lo, hi in zip(class_keys(hashes, at), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if cls is None or cls in seen:
                        continue
                    own = hashes[lo:hi]
                    prefix = order.prefix(own, prefix_length(hi - lo, percent))
                    place = np.flatnonzero(shared.passes(prefix))
                    if len(place):
                        if len(seen) < 1 << 20:
                            seen.add(cls)
                        rows.append((cls, hi - lo))
                        keys.append(prefix[place].view(np.int64))
                        places.append(place)
                        signs.append(signature(own))
                        fine.append(fine_signature(own))
                s = np.array(signs, np.int64).reshape(-1, WORDS)
                ends = np.cumsum([0, *[len(x) for x in keys]]).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int32))],
                    names=["key", "place"],
                )
                lists = pa.ListArray.from_arrays(pa.array(ends), pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.binary()), pa.array([_half(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *[pa.array(s[:, i]) for i in range(WORDS)], lists, pa.array(fine, pa.binary())],
                    names=["cls", "half", "n", *_SIGNATURE, "keys", "fine"],
                )

    return run


def _half(cls: bytes) -> int:
    return int.from_bytes(cls[:8], "little", signed=True)


def _sets_of(k: int, wanted: KeyFilter):
    """Shingle hashes of the classes that ``wanted`` passes; each once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        seen: set[bytes] = set()
        for batch in batches:
            for _, hashes, at in shingler.sets(batch.column(0)):
                keys = class_keys(hashes, at)
                passed = wanted.passes(np.array([_half(c) if c else 0 for c in keys], np.int64))
                names, sets = [], []
                for d in np.flatnonzero(passed).tolist():
                    cls = keys[d]
                    if cls is not None and cls not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(cls)
                        names.append(cls)
                        sets.append(hashes[at[d] : at[d + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "hashes"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), batch.column(1).take(pa.array(keep, pa.int32()))], names=["a", "b"])

    return run


def _possible(percent: int, x: str, y: str) -> Column:
    """Whether the bounds on sizes and signatures leave a link possible."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))).cast("long") for s in _SIGNATURE), F.lit(0).cast("long"))
    # overlap <= (n + m - apart) / 2, union >= (n + m + apart) / 2
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * (n + m - apart) >= percent * (n + m + apart))


def linked_classes(candidates: DataFrame, text: DataFrame, shingle_words: int, percent: int, log2_filter_bits: int) -> DataFrame:
    """Links ``(a, b)`` that suffice to join all classes that are linked, or reach each other by links.

    ``candidates`` is a written table, one row per class. The shingles of the few classes that
    the bounds leave are taken from the texts again, so the others are never moved.
    """
    slim = candidates.select("cls", "half", "n", *_SIGNATURE)
    # Two sets of one link have bands that are equal or neighbours.
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")

    def bounded(pairs: DataFrame) -> DataFrame:
        """Of ``(x, y)``, halves that name classes, the pairs of classes that the bounds leave."""
        side = F.struct("cls", "half", "n", *_SIGNATURE)
        return (
            pairs.join(slim.select(F.col("half").alias("x"), side.alias("p")), "x")
            .join(slim.select(F.col("half").alias("y"), side.alias("q")), "y")
            .where(_possible(percent, "p", "q"))
            .select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b"), F.array("p.half", "q.half").alias("halves"), F.col("p.n").alias("n"), F.col("q.n").alias("m"), *[c for c in pairs.columns if c not in ("x", "y")])
        )

    def checked(met: DataFrame) -> DataFrame:
        """The links among bounded pairs, a written table."""
        large = (F.col("n") > COARSE) & (F.col("m") > COARSE)
        near = met.select("a", "b", "halves")
        if met.where(large).count():
            finer = (
                met.where(large)
                .join(candidates.select(F.col("cls").alias("a"), F.col("fine").alias("fa")), "a")
                .join(candidates.select(F.col("cls").alias("b"), F.col("fine").alias("fb")), "b")
                .select("a", "b", "halves", "n", "m", "fa", "fb")
                .mapInArrow(_fine_bound(percent), "a binary, b binary, halves array<long>")
            )
            near = settle(met.where(~large).select("a", "b", "halves").unionByName(finer), "pairs")
        wanted = key_filter(near.select(F.explode("halves").alias("key")), "key", log2_filter_bits)
        sets = text.mapInArrow(_sets_of(shingle_words, wanted), "cls binary, hashes binary").dropDuplicates(["cls"])
        full = (
            near.select("a", "b")
            .join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
            .join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a")
        )
        return settle(full.select("a", "b", "ha", "hb").mapInArrow(_verify(percent), "a binary, b binary"), "links")

    # Stars: every class of a tile with one leader. What a round joins gets one label, and need
    # not be compared pair by pair. At first most tiles of a group have the same leader, which
    # joins close copies with few comparisons; then every tile draws its own, so that classes of a
    # looser group meet many. Leaders do not depend on labels, so those of all rounds are drawn
    # at once: the smallest half, seen through a mask that gives it back.
    rows = candidates.select("half", band.alias("band"), F.explode("keys.key").alias("key"))
    seen = [F.col("half").bitwiseXOR(F.xxhash64(F.lit(number), "key")) if number else F.col("half") for number in range(STAR_ROUNDS)]
    drawn = rows.groupBy("key", "band").agg(F.count(F.lit(1)).alias("size"), *[F.min(h).alias(f"h{number}") for number, h in enumerate(seen)])
    leads = drawn.where(F.col("size") > 1).select(
        "key", "band", F.array(*[F.col(f"h{number}").bitwiseXOR(F.xxhash64(F.lit(number), "key")) if number else F.col("h0") for number in range(STAR_ROUNDS)]).alias("leads")
    )
    # A pair is looked at in the first round that draws it.
    stars = (
        rows.join(leads, ["key", "band"])
        .select("half", F.posexplode("leads").alias("number", "lead"))
        .where(F.col("half") != F.col("lead"))
        .groupBy(F.least("half", "lead").alias("x"), F.greatest("half", "lead").alias("y"))
        .agg(F.min("number").alias("number"))
    )
    stars = settle(bounded(stars), "pairs")
    links, labels = None, None
    for number in range(STAR_ROUNDS):
        met = stars.where(F.col("number") == number).drop("number")
        if labels is not None:
            of = lambda c: labels.select(F.col("cls").alias(c), F.col("label").alias(f"l{c}"))  # noqa: E731, B023
            known = met.join(of("a"), "a", "left").join(of("b"), "b", "left")
            met = settle(known.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*met.columns), "pairs")
        found = checked(met)
        links = found if links is None else links.unionByName(found)
        if number + 1 < STAR_ROUNDS:
            labels = settle(_relabelled(found, labels), "labels")
    # Now the label is the component. Tiles with more than one, with the band above as the other side.
    roots = connected(links)
    of_class = roots.select(F.col("node").alias("cls"), F.col("root").alias("label"))
    # It is only compared, so a number does for it.
    label = F.xxhash64(F.coalesce("label", "cls")).alias("label")
    labelled = settle(candidates.select("cls", "half", "n", "keys").join(of_class, "cls", "left").select("half", "n", label, "keys"), "labelled")
    rows = labelled.select("half", "n", "label", band.alias("band"), F.inline("keys"))
    reach = rows.select("key", "label", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    mixed = reach.groupBy("key", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("key", "band")
    mixed = settle(mixed, "mixed")
    # Signatures are fetched for the rows of such tiles only.
    met = rows.join(mixed.select("key").distinct(), "key", "left_semi")
    signed = settle(met.join(slim.drop("n", "cls"), "half"), "tiles")
    left = signed.join(mixed, ["key", "band"], "left_semi").alias("x")
    right = signed.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).join(mixed, ["key", "band"], "left_semi").alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.half") < F.col("y.half")))
    # The first key that two sets share has all they share behind it in both.
    left_over = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    behind = (100 + percent) * left_over >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = left.join(
        right,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.band") == F.col("y.band")) & smaller & (F.col("x.label") != F.col("y.label")) & behind & _possible(percent, "x", "y"),
    ).select(F.col("x.half").alias("x"), F.col("y.half").alias("y"))
    # The components found stand for the links that made them, and need no rounds again.
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(checked(settle(bounded(pairs.distinct()), "pairs")))


def _relabelled(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``(cls, label)`` of classes that have another label than themselves, after the
    ``links`` of a round.

    A label takes the smallest one it is linked with, twice, so the labels of a star become
    one. Equal labels are joined by links; unequal ones may be too.
    """
    if labels is None:
        edges = links
    else:
        of = lambda c: labels.select(F.col("cls").alias(c), F.col("label").alias(f"l{c}"))
        known = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        edges = known.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    edges = edges.where(F.col("a") != F.col("b")).distinct()
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    once = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    twice = both.join(once.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
    passed = twice.join(once.withColumnRenamed("m", "own"), "a").select(F.col("a").alias("label"), F.least("m", "own").alias("to")).where(F.col("label") != F.col("to"))
    if labels is None:
        return passed.select(F.col("label").alias("cls"), F.col("to").alias("label"))
    moved = labels.join(passed, "label", "left").select("cls", F.coalesce("to", "label").alias("label"))
    return moved.unionByName(passed.select(F.col("label").alias("cls"), F.col("to").alias("label")).join(labels.select("cls"), "cls", "left_anti"))


def jaccard_components(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
    log2_filter_bits: int = DEFAULT_LOG2_BITS,
) -> DataFrame:
    """``(id_column, n_shingles, component_id)`` for every row of ``docs``.

    Words are runs of characters other than space, tab, line feed, vertical tab, form
    feed and carriage return, with A-Z in lower case. A document is the set of its
    shingles of ``shingle_words`` words; with fewer words, the whole sequence is its one
    shingle. Two link when ``100 * common >= percent * union``. The component is named
    by the smallest id in it.

    A null text is empty, and empty documents link with nothing. A row with a null id
    is like any other, but ids that are null name no component (null if there is no other).
    Repeated rows are in one component.
    """
    rows = pick(docs, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()
    parts = settle(rows.mapInArrow(_sets_and_frequent(shingle_words), f"id {kind}, cls binary, n long, shingle long"), "sets")
    members = parts.where(F.col("shingle").isNull()).select("id", "cls", "n")
    often = parts.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("n").alias("n"))
    listed = often.orderBy(F.desc("n"), "shingle").limit(FREQUENT_SHINGLES).toArrow()
    hot = listed.column("shingle").to_numpy().view(np.uint64)
    by_hash = np.argsort(hot)
    order = Order(hot[by_hash], listed.column("n").to_numpy()[by_hash])

    text = rows.select("text")
    counted = text.mapInArrow(_prefix_keys(shingle_words, percent, order), "key long").groupBy("key").count()
    shared = key_filter(counted.where(F.col("count") > 1), "key", log2_filter_bits)
    fields = ", ".join(f"{s} long" for s in _SIGNATURE)
    found = text.mapInArrow(_candidates(shingle_words, percent, order, shared), f"cls binary, half long, n long, {fields}, keys array<struct<key:long, place:int>>, fine binary")
    candidates = settle(found.dropDuplicates(["cls"]), "candidates")
    links = linked_classes(candidates, text, shingle_words, percent, log2_filter_bits)
    roots = connected(links).withColumnRenamed("node", "cls")
    classes = members.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("least")).join(roots, "cls", "left")
    classes = classes.withColumn("root", F.coalesce("root", "cls"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = classes.join(named, "root").select("cls", "component_id")
    return members.join(by_class, "cls", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the one with the
    smallest id, of equal ids the one with the smallest hash of id and text. Rows equal in id and text
    count as one. Empty documents have no copies but such rows. A null id is the smallest."""
    r1, r2 = row_hashes(id_column, text_column)
    named = docs.select(F.struct(F.col(id_column).alias("id"), r1.alias("r1"), r2.alias("r2")).alias("row"), F.col(text_column).alias("text"))
    found = jaccard_components(named, shingle_words, percent, "row", "text")
    k1, k2 = fresh(docs, "r1", "r2")
    kept = found.where(F.col("row").eqNullSafe(F.col("component_id"))).select(F.col("row.r1").alias(k1), F.col("row.r2").alias(k2)).distinct()
    keyed = docs.withColumns({k1: r1, k2: r2})
    return keyed.join(kept, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*docs.columns)
