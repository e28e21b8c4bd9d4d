"""Maximal periodic runs of words, found in grammar-compressed documents.

The word ids of a slice of documents become one grammar in the manner of Re-Pair: pairs of
symbols that occur more than once are replaced by a nonterminal, frequent ones first. Of
pairs about equally frequent many are replaced in one round, where they do not overlap. What
is left of a document is paired up into a balanced tree. A run lies across the boundary of
the lowest node that covers it, so the runs across each nonterminal's boundary are computed
once, at one of its places, and translated to all places that it derives. An interval that
is cut off at the edge of a nonterminal lies within a longer one of the same period, and
goes when they are merged.

Equality of stretches is exact: stretches of 1, 2, 4, ... words are named by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packsift.llm.tables import pick
from packsift.llm.textbytes import grams, inside, slices, splitmix, text_buffer

MIN_LENGTH = 12
#: Pairs of equal stretches that are extended at a time.
EXTENDED = 1 << 19


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    values, names = np.unique(keys, return_inverse=True)
    return names, len(values)


class Stretches:
    """Names of the stretches of 2^k words from each place of ``words``, up to the first k
    for which no two are equal."""

    def __init__(self, words: np.ndarray):
        names, count = _named(words)
        self.levels = [names]
        while count < len(names) and len(names) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            names, count = _named(names[:-half] * np.int64(count) + names[half:])
            self.levels.append(names)

    def of_length(self, n: int) -> np.ndarray:
        """Names of the stretches of ``n`` words, or of the longest with repetitions."""
        n = min(n, (1 << len(self.levels)) - 1)
        out, done = None, 0
        for k in reversed(range(len(self.levels))):
            if n >> k & 1:
                part = self.levels[k][done:]
                out = part if out is None else _named(out[: len(part)] * np.int64(len(self.levels[0]) + 1) + part[: len(out)])[0]
                done += 1 << k
        return out

    def forward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``x`` and from ``y`` are equal, at most ``most``."""
        return self._extend(x, y, most, 1)

    def backward(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``x`` and before ``y`` are equal."""
        return self._extend(x, y, most, -1)

    def _extend(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        done = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.levels))):
            step, names = 1 << k, self.levels[k]
            fits = np.flatnonzero(done + step <= most)
            at = done[fits] if way > 0 else -done[fits] - step
            same = names[x[fits] + at] == names[y[fits] + at]
            done[fits[same]] += step
        return done


@dataclass
class Grammar:
    """Nonterminals by number, children before parents; terminals have numbers below
    ``terminals``. ``place`` is one place of each in the words, ``round_ends`` separates
    nonterminals of which none contains another; ``roots`` are the documents' symbols with
    their places."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    place: np.ndarray
    round_ends: list[int]
    roots: np.ndarray
    root_places: np.ndarray


def compress_words(words: np.ndarray, terminals: int, firsts: np.ndarray) -> Grammar:
    """``words``: numbers below ``terminals``, a negative one between documents;
    ``firsts``: where documents begin."""
    lefts, rights, lengths, places, round_ends, made = [], [], [], [], [], terminals
    size = np.ones(terminals, np.int64)

    def make(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        nonlocal made, size
        lefts.append(left), rights.append(right), places.append(at)
        lengths.append(size[left] + size[right])
        size = np.concatenate([size, lengths[-1]])
        made += len(left)
        round_ends.append(made - terminals)
        return np.arange(made - len(left), made)

    bound = np.int64(terminals + len(words) + 1)
    symbols, at = words.astype(np.int64), np.arange(len(words))
    live = np.ones(max(len(words) - 1, 0), bool)
    rules: dict[int, int] = {}
    while live.any():
        # Of three equal symbols in a row the first two are a pair.
        same = np.append(symbols[:-1] == symbols[1:], False)
        head = np.maximum.accumulate(np.where(same & ~np.insert(same[:-1], 0, False), np.arange(len(same)), 0))
        odd = same & ((np.arange(len(same)) - head) % 2 == 1)
        pair = np.flatnonzero(live & ~odd[:-1] & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
        keys, names, counts = np.unique(symbols[pair] * bound + symbols[pair + 1], return_inverse=True, return_counts=True)
        # Frequent pairs first, by powers of two; equally frequent ones in an order of chance.
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((splitmix(keys), -np.floor(np.log2(counts))))] = np.arange(len(keys))
        often = counts[names] > 1
        candidate = np.full(len(symbols) + 1, len(keys), np.int64)
        candidate[pair[often] + 1] = rank[names[often]]
        chosen = pair[often][(candidate[pair[often] + 1] < candidate[pair[often]]) & (candidate[pair[often] + 1] < candidate[np.minimum(pair[often] + 2, len(symbols))])]
        if not len(chosen):
            break
        keys, first, names = np.unique(symbols[chosen] * bound + symbols[chosen + 1], return_index=True, return_inverse=True)
        known = np.array([rules.get(k, -1) for k in keys.tolist()], np.int64)
        new = known < 0
        known[new] = make(*divmod(keys[new], bound), at[chosen[first[new]]])
        rules.update(zip(keys[new].tolist(), known[new].tolist(), strict=True))
        # Only pairs that were frequent, or hold a symbol of this round, can be frequent.
        still = np.zeros(len(symbols), bool)
        still[pair[often]] = True
        fresh = np.zeros(len(symbols), bool)
        fresh[chosen] = True
        symbols[chosen] = known[names]
        stays = np.ones(len(symbols), bool)
        stays[chosen + 1] = False
        symbols, at, still, fresh = symbols[stays], at[stays], still[stays], fresh[stays]
        # An odd pair of equal symbols was not counted; it may be one now.
        live = still[:-1] | fresh[:-1] | fresh[1:] | (symbols[:-1] == symbols[1:])

    inner = symbols >= 0
    symbols, at = symbols[inner], at[inner]
    doc = np.searchsorted(firsts, at, "right") - 1
    while len(symbols) and (doc[1:] == doc[:-1]).any():
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        order = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(doc))))
        paired = np.flatnonzero((order[:-1] % 2 == 0) & (doc[1:] == doc[:-1]))
        symbols[paired] = make(symbols[paired], symbols[paired + 1], at[paired])
        stays = np.ones(len(symbols), bool)
        stays[paired + 1] = False
        symbols, at, doc = symbols[stays], at[stays], doc[stays]
    joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
    return Grammar(terminals, joined(lefts), joined(rights), joined(lengths), joined(places), round_ends, symbols, at)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and which member, for all members of the ranges."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


def crossing_runs(grammar: Grammar, stretches: Stretches, min_length: int) -> tuple[np.ndarray, ...]:
    """``(nonterminal, start, end, period)``, positions within the nonterminal: its periodic
    intervals across its boundary that cannot be extended within it."""
    # A run of period q repeats max(q, min_length - q) words or more at distance q, split by the
    # boundary in two; so this many words on one side of it, at least, are equal.
    anchor = -(-min_length // 4)
    named = stretches.of_length(anchor)
    anchor = len(stretches.levels[0]) - len(named) + 1
    n = np.int64(len(named) + 1)
    sorted_places = np.sort(named * n + np.arange(len(named)))
    long = np.flatnonzero(grammar.length >= min_length)
    found = []
    for back in (0, anchor):
        p, length = grammar.place[long], grammar.length[long]
        left = grammar.left[long]
        own = np.where(left < grammar.terminals, 1, grammar.length[np.maximum(left - grammar.terminals, 0)])
        fits = (own >= back) & (length - own >= anchor - back)
        p, b, e, node = p[fits], (p + own)[fits], (p + length)[fits], long[fits]
        t = b - back
        lo = np.searchsorted(sorted_places, named[t] * n + p)
        hi = np.searchsorted(sorted_places, named[t] * n + e - anchor, "right")
        ends = np.cumsum(hi - lo)
        at = 0
        while at < len(t):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXTENDED, "right")))
            which, member = _ranges(lo[at:to], hi[at:to])
            which += at
            q = sorted_places[member] % n - t[which]
            which, q = which[q != 0], q[q != 0]
            x = b[which] + np.minimum(q, 0)
            y = b[which] + np.maximum(q, 0)
            period = y - x
            inner = (x >= p[which]) & (y <= e[which])
            which, x, y, period = which[inner], x[inner], y[inner], period[inner]
            end = y + stretches.forward(x, y, e[which] - y)
            start = x - stretches.backward(x, y, x - p[which])
            run = (end - start >= np.maximum(min_length, 2 * period)) & (start < b[which]) & (end > b[which])
            which, start, end = which[run], start[run] - p[which[run]], end[run] - p[which[run]]
            found.append(np.stack([node[which], start, end, period[run]]))
            at = to
    found = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
    # Of one interval's periods the smallest divides the others.
    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    first = np.ones(found.shape[1], bool)
    first[1:] = (found[:3, 1:] != found[:3, :-1]).any(axis=0)
    return tuple(found[:, first])


def maximal_runs(words: np.ndarray, terminals: int, firsts: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs, in the order of start, then period."""
    grammar = compress_words(words, terminals, firsts)
    node, start, end, period = crossing_runs(grammar, Stretches(words), min_length)
    count = np.bincount(node, minlength=len(grammar.left))
    first = np.concatenate([[0], np.cumsum(count)])
    holds = count > 0
    lo = 0
    child = lambda c: np.where(c < grammar.terminals, False, holds[np.maximum(c - grammar.terminals, 0)])
    for hi in grammar.round_ends:
        if hi > lo:
            holds[lo:hi] |= child(grammar.left[lo:hi]) | child(grammar.right[lo:hi])
        lo = hi
    symbols, places, found = grammar.roots, grammar.root_places, []
    while len(symbols):
        inner = symbols >= grammar.terminals
        inner[inner] = holds[symbols[inner] - grammar.terminals]
        nodes, places = symbols[inner] - grammar.terminals, places[inner]
        which, member = _ranges(first[nodes], first[nodes + 1])
        found.append(np.stack([places[which] + start[member], places[which] + end[member], period[member]]))
        left, right = grammar.left[nodes], grammar.right[nodes]
        own = np.where(left < grammar.terminals, 1, grammar.length[np.maximum(left - grammar.terminals, 0)])
        symbols, places = np.concatenate([left, right]), np.concatenate([places, places + own])
    start, end, period = np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)
    # Merge: within one period, what lies in another interval is a part of it.
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = period * np.int64(len(words) + 1) + end
    longest = np.ones(len(start), bool)
    longest[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    start, end, period = start[longest], end[longest], period[longest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _numbered(docs: list[list[bytes]]) -> tuple[np.ndarray, int]:
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    for words in docs:
        for word in words:
            if word not in numbers:
                numbers[word] = len(numbers)
        flat += map(numbers.__getitem__, words)
    return np.array(flat, np.int64), len(numbers)


def _repeating(ids: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Documents in which ``k`` words occur twice; others have no run of twice as many.
    Hashes decide, so a few more may be named."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = inside(first, k)
    keys = np.sort((doc[valid].astype(np.uint64) << np.uint64(40)) | (grams(splitmix(ids), k)[valid] >> np.uint64(24)))
    return np.unique(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(40)).astype(np.int64)


def runs_of(docs: list[list[bytes]], min_length: int = MIN_LENGTH) -> dict[int, np.ndarray]:
    """Rows ``(start, end, period)`` for the documents that have a run."""
    ids, count = _numbered(docs)
    first = np.concatenate([[0], np.cumsum([len(words) for words in docs])]).astype(np.int64)
    chosen = _repeating(ids, first, -(-min_length // 2))
    if not len(chosen):
        return {}
    parts, firsts, at = [], [], 0
    for d in chosen.tolist():
        parts += [ids[first[d] : first[d + 1]], np.array([-1 - d])]
        firsts.append(at)
        at += int(first[d + 1] - first[d]) + 1
    firsts = np.array(firsts, np.int64)
    start, end, period = maximal_runs(np.concatenate(parts), count, firsts, min_length)
    owner = np.searchsorted(firsts, start, "right") - 1
    rows = np.stack([start - firsts[owner], end - firsts[owner], period], axis=1)
    cuts = np.searchsorted(owner, np.arange(len(chosen) + 1))
    return {d: rows[cuts[i] : cuts[i + 1]] for i, d in enumerate(chosen.tolist()) if cuts[i + 1] > cuts[i]}


def collapsed(words: list[bytes], runs: np.ndarray | None) -> bytes:
    """The words but those behind the first period of a run, joined by one space."""
    if runs is None:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _finder(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 3), np.int64)
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for a, b in slices(offs):
                docs = [data[offs[d] : offs[d + 1]].tobytes().split() for d in range(a, b)]
                found = runs_of(docs, min_length)
                rows = np.concatenate([none, *[found[d] for d in sorted(found)]])
                ends = np.cumsum([0, *[len(found.get(d, none)) for d in range(b - a)]]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], fields=list(_RUN))
                texts = [collapsed(words, found.get(d)) for d, words in enumerate(docs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), spans), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["id", "runs", "collapsed"],
                )

    return run


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, runs array<struct<start, length, period>>, collapsed)`` for every row
    of ``docs``.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed
    and carriage return, numbered from 0. A run is a stretch of words with smallest period q
    (words q apart are equal) of at least ``max(min_length, 2 * q)`` words that cannot be
    extended on either side; runs are listed by start, then period, and may overlap.
    ``collapsed`` are the words without those that lie in a run behind its first q words,
    joined by one space.

    A null, empty or blank text has no runs and collapses to the empty text. Null and
    repeated ids are rows like others; an empty table gives no rows. Memory follows the
    longest document.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")
    rows = pick(docs, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, runs array<struct<start:long, length:long, period:long>>, collapsed string"
    return rows.mapInArrow(_finder(min_length), fields).withColumnRenamed("id", id_column)
