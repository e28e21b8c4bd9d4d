"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut into words at its spaces, and words into segments wherever two neighbouring
characters stand side by side in no piece of the model: no merge can cross. The new words of
a slice of documents are one flat array of symbols. In each round every segment merges all
places of its best pair, from left to right where they overlap; the array is compacted, and
segments without a pair of the model leave it. Merging all places at once is the same as one
after the other unless a merge makes a pair that is at least as good as the one merged; such
segments, and those that need very many rounds, are finished merge by merge.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from packsift.llm.tables import pick
from packsift.llm.textbytes import slices, text_buffer

#: Words that a task keeps encoded, each of at most so many characters; when there are more,
#: it starts afresh.
KEPT_WORDS, KEPT_CHARACTERS = 200_000, 64
#: Characters that are merged at a time, and rounds before the rest goes merge by merge.
TOGETHER = 1 << 20
ROUNDS = 128

# Kinds of pieces and of models in model files, the mark for a space.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
SPACE = "▁"

_NONE = np.int64(1 << 40)
_WORD = re.compile(" +[^ ]*")
_CHARACTERS = 0x110000


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a message in the protocol buffer format."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class KeyTable:
    """Finds places of distinct keys (not negative) by hash, many in one call."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.places = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.places[slot[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that is not there."""
        slot, left = self._slot(keys), np.arange(len(keys))
        out = np.full(len(keys), -1, np.int64)
        while len(left):
            seen, asked = self.keys[slot], keys[left]
            same = seen == asked
            out[left[same]] = self.places[slot[same]]
            on = ~same & (seen >= 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


class PieceModel:
    """Tables of a model: which pairs of symbols merge into what and in which order, and
    which characters may stand side by side. A symbol is the id of a piece, or for a
    character that is no piece ``size`` and its code point."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        parts = [dict(_fields(value)) for field, value in message if field == 1]
        trainer, normalizer = ({k: v for f, m in message if f == field for k, v in _fields(m)} for field in (2, 3))
        pieces = [p.get(1, b"").decode() for p in parts]
        kinds = [p.get(3, NORMAL) for p in parts]
        plain = normalizer.get(2, b"") == b"" and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or trainer.get(24, 0) or not plain or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must be BPE with byte fallback, without normalization or pieces of the user's")
        self.size = len(pieces)
        self.begin, self.end = (pieces.index(trainer.get(field, name).decode()) for field, name in ((46, b"<s>"), (47, b"</s>")))
        self.byte_ids = np.zeros(256, np.int64)
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                self.byte_ids[int(pieces[i][1:-1], 16)] = i
        scores = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in parts])
        self.fill({p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}, scores)

    def fill(self, ids: dict[str, int], scores: np.ndarray) -> None:
        """The tables of the pieces ``ids``; equal scores are equal in order."""
        order = np.unique(-scores, return_inverse=True)[1]
        self.symbols = np.arange(self.size, self.size + _CHARACTERS)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        self.bound = np.int64(self.size + _CHARACTERS)
        pairs, beside = {}, set()
        for piece, i in ids.items():
            beside |= {(ord(a) << 21) | ord(b) for a, b in zip(piece, piece[1:], strict=False)}
            for cut in range(1, len(piece)):
                left, right = (int(self.symbols[ord(x)]) if len(x) == 1 else ids.get(x) for x in (piece[:cut], piece[cut:]))
                if left is not None and right is not None:
                    pairs[left * int(self.bound) + right] = i
        if any(key & 0x1FFFFF == ord(SPACE) and key >> 21 != ord(SPACE) for key in beside):
            raise ValueError("a piece goes on behind a space")
        self.pairs = KeyTable(np.array([*pairs], np.int64))
        self.merged = np.array([*pairs.values()], np.int64)
        self.order = order[self.merged]
        self.beside = KeyTable(np.array([*beside], np.int64))
        self.table = {k: (int(o), m) for (k, m), o in zip(pairs.items(), self.order.tolist(), strict=True)}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the merge of each pair, and the piece it makes; no merge: ``_NONE``."""
        keys = left * self.bound + right
        at = self.pairs.find(keys)
        return np.where(at >= 0, self.order[at], _NONE), self.merged[at]

    def side_by_side(self, characters: np.ndarray) -> np.ndarray:
        keys = (characters[:-1].astype(np.int64) << 21) | characters[1:]
        return self.beside.find(keys) >= 0


def merge_by_merge(model: PieceModel, symbols: list[int]) -> list[tuple[int, int]]:
    """What is left when pairs merge one at a time, best first, then leftmost; each symbol
    with the position of its first one."""
    n, bound = len(symbols), int(model.bound)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            pair = model.table.get(symbols[i] * bound + symbols[after[i]])
            if pair:
                heapq.heappush(heap, (pair[0], i, symbols[i], symbols[after[i]]))

    for i in range(n):
        push(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i] = model.table[left * bound + right][1]
        symbols[j] = -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(before[i])
        push(i)
    return [(i, s) for i, s in enumerate(symbols) if s >= 0]


def merge_rounds(model: PieceModel, characters: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Symbols at the places of their first characters, -1 elsewhere. ``words``: where words
    begin in the flat array of ``characters``."""
    out = np.full(len(characters), -1, np.int64)
    symbols, place = model.symbols[characters], np.arange(len(characters))
    joined = np.append(model.side_by_side(characters), False)
    joined[words[words > 0] - 1] = False
    best, piece = model.look_up(symbols, np.append(symbols[1:], 0))
    best[~joined] = _NONE
    starts = np.flatnonzero(~np.insert(joined[:-1], 0, False))
    for _ in range(ROUNDS):
        # Segments without a pair are done.
        least = np.minimum.reduceat(best, starts)
        size = np.diff(np.append(starts, len(symbols)))
        done = least == _NONE
        gone = np.repeat(done, size)
        out[place[gone]] = symbols[gone]
        symbols, place, best, piece = symbols[~gone], place[~gone], best[~gone], piece[~gone]
        least, size = least[~done], size[~done]
        starts = np.cumsum(size) - size
        if not len(symbols):
            return out
        # All places of the best pair, every other one where they overlap.
        at_best = best == np.repeat(least, size)
        head = np.flatnonzero(at_best & ~np.insert(at_best[:-1], 0, False))
        place_of = np.flatnonzero(at_best)
        chosen = place_of[(place_of - head[np.searchsorted(head, place_of, "right") - 1]) % 2 == 0]
        segment = np.searchsorted(starts, chosen, "right") - 1
        new = piece[chosen]
        last = (starts + size)[segment] - 1
        behind = chosen + 2 <= last
        ahead = chosen > starts[segment]
        follows = np.insert((np.diff(chosen) == 2) & (segment[1:] == segment[:-1]), 0, False) if len(chosen) else np.zeros(0, bool)
        to_left = np.where(follows, np.insert(new[:-1], 0, 0), symbols[np.maximum(chosen - 1, 0)])
        left_best, left_piece = model.look_up(to_left, new)
        left_best[~ahead] = _NONE
        right_best, right_piece = model.look_up(new, symbols[np.minimum(chosen + 2, len(symbols) - 1)])
        right_best[~behind] = _NONE
        several = np.bincount(segment, minlength=len(starts)) > 1
        early = np.zeros(len(starts), bool)
        early[segment[np.minimum(left_best, right_best) <= least[segment]]] = True
        early &= several
        # What two merged neighbours make is the pair to the left of the second one.
        followed = np.append(follows[1:], False)
        best[chosen] = np.where(followed, np.append(left_best[1:], _NONE), right_best)
        piece[chosen] = np.where(followed, np.append(left_piece[1:], 0), right_piece)
        one = ahead & ~follows
        stays = np.ones(len(symbols), bool)
        stays[chosen + 1] = False
        if early.any():
            for i in np.flatnonzero(early).tolist():
                lo, hi = int(starts[i]), int(starts[i] + size[i])
                for k, symbol in merge_by_merge(model, symbols[lo:hi].tolist()):
                    out[place[lo + k]] = symbol
            stays &= ~np.repeat(early, size)
        best[chosen[one] - 1], piece[chosen[one] - 1] = left_best[one], left_piece[one]
        symbols[chosen] = new
        size = np.add.reduceat(stays.astype(np.int64), starts)
        symbols, place, best, piece = symbols[stays], place[stays], best[stays], piece[stays]
        size = size[size > 0]
        starts = np.cumsum(size) - size
        if not len(symbols):
            return out
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(symbols)], strict=True):
        for k, symbol in merge_by_merge(model, symbols[lo:hi].tolist()):
            out[place[lo + k]] = symbol
    return out


class PieceCoder:
    """Ids of words by merge rounds, each word once as long as it is kept."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.kind = np.dtype("<u2" if self.model.size <= 1 << 16 else "<u4")
        self.kept: dict[str, bytes] = {}

    def _encode(self, words: list[str], size: np.ndarray) -> Iterator[bytes]:
        model = self.model
        first = np.concatenate([[0], np.cumsum(size)])
        characters = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        out = merge_rounds(model, characters, first[:-1])
        at = np.flatnonzero(out >= 0)
        symbols = out[at]
        foreign = symbols >= model.size
        raw = "".join(map(chr, (symbols[foreign] - model.size).tolist())).encode()
        points = symbols - model.size
        width = np.where(foreign, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1)
        ids = np.repeat(symbols, width)
        ids[np.repeat(foreign, width)] = model.byte_ids[np.frombuffer(raw, np.uint8)]
        packed = ids.astype(self.kind).tobytes()
        ends = np.concatenate([[0], np.cumsum(width)])[np.searchsorted(at, first)] * self.kind.itemsize
        marks = ends.tolist()
        return (packed[lo:hi] for lo, hi in zip(marks[:-1], marks[1:], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, without begin and end."""
        split = [_WORD.findall(" " + text.replace(SPACE, " ")) if text else [] for text in texts]
        wanted: set[str] = set().union(*split)
        new = [w for w in wanted if w not in self.kept]
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept, new = {}, list(wanted)
        size = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(size)
        at = 0
        while at < len(new):
            before = int(ends[at] - size[at])
            to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            self.kept.update(zip(new[at:to], self._encode(new[at:to], size[at:to]), strict=True))
            at = to
        ids = [b"".join(map(self.kept.__getitem__, words)) for words in split]
        for i in np.flatnonzero(size > KEPT_CHARACTERS).tolist():
            del self.kept[new[i]]
        return ids


def _coder(path: str, begin: bool, end: bool, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        coder, library = PieceCoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
        lead = np.array([coder.model.begin] * begin, coder.kind).tobytes()
        tail = np.array([coder.model.end] * end, coder.kind).tobytes()
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for a, b in slices(offs):
                texts = [data[offs[d] : offs[d + 1]].tobytes().decode() for d in range(a, b)]
                ids = [np.frombuffer(lead + x + tail, coder.kind) for x in coder.encode(texts)]
                if packed:
                    column = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                else:
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                decoded = [library.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    return run


def encode_documents(
    docs: DataFrame,
    model_path: str,
    begin: bool = True,
    end: bool = True,
    packed: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id_column, ids, decoded)`` for every row of ``docs``: the ids that the library gives
    for the whole text without sampling, with those of begin and end, and what its ``decode``
    makes of them. ``ids`` is an array of integers, or ``packed`` in four bytes each, lowest
    byte first.

    A null text is empty: its ids are begin and end, and it decodes to the empty text. Null
    and repeated ids are rows like others; an empty table gives no rows. Models with
    normalization, pieces of the user's or without byte fallback are refused.
    """
    PieceModel(model_path)
    rows = pick(docs, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, ids {'binary' if packed else 'array<int>'}, decoded string"
    return rows.mapInArrow(_coder(model_path, begin, end, packed), fields).withColumnRenamed("id", id_column)
