"""Fill-in-the-middle examples: texts cut at two line ends and put in another order.

The line ends of a text are a set of byte offsets in the manner of Roaring bitmaps: offsets
with equal high bits share a container, which is a sorted array, a bitmap or a list of runs,
whichever is smallest. The numbers of members before each container and within it are kept
as running sums, so the end of line k is found by a search among the containers and a select
within one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.llm.tables import pick
from packsift.llm.textbytes import slices, text_buffer

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
LOW_BITS = 16
LINE_FEED = 10


class ArrayContainer:
    """Low bits of the members, sorted."""

    def __init__(self, low: np.ndarray):
        self.low = low

    @staticmethod
    def size(count: int, runs: int) -> int:
        return 2 * count

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for each possible member, and the members before each word of 64 bits."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def size(count: int, runs: int) -> int:
        return 1 << (LOW_BITS - 3)

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1
        return 64 * at + (word & -word).bit_length() - 1


class RunContainer:
    """First members of stretches of neighbours, and the members before each stretch."""

    def __init__(self, low: np.ndarray):
        at = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
        self.first, self.before = low[at], at

    @staticmethod
    def size(count: int, runs: int) -> int:
        return 2 + 4 * runs

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[at]) + k - int(self.before[at])


KINDS = (ArrayContainer, RunContainer, BitmapContainer)


class BoundarySet:
    """A set of offsets from its sorted members."""

    def __init__(self, members: np.ndarray):
        high = members >> LOW_BITS
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[starts].tolist()
        self.before = [*starts.tolist(), len(members)]
        self.containers = []
        for a, b in zip(self.before[:-1], self.before[1:], strict=True):
            low = (members[a:b] & ((1 << LOW_BITS) - 1)).astype(np.uint16)
            runs = 1 + int(np.count_nonzero(np.diff(members[a:b]) != 1))
            self.containers.append(min(KINDS, key=lambda kind: kind.size(b - a, runs))(low))

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        """The member with ``k`` members before it."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (self.keys[at] << LOW_BITS) + self.containers[at].select(k - self.before[at])


def line_ends(data: np.ndarray) -> BoundarySet:
    """Offsets behind each line of a text in UTF-8; what follows the last line feed is a
    line too."""
    ends = np.flatnonzero(data == LINE_FEED) + 1
    if len(data) and data[-1] != LINE_FEED:
        ends = np.append(ends, len(data))
    return BoundarySet(ends)


def check_marks(marks: tuple[str, str, str]) -> None:
    """Refuse marks that could overlap: then a mark could arise where text meets a mark,
    and the text could not be rebuilt."""
    for a, b in product(marks, marks):
        if any(a.endswith(b[:n]) for n in range(1, len(b))) or (a in b and a != b):
            raise ValueError(f"marks {a!r} and {b!r} may overlap")
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks are needed")


def draws(id_value: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on the id and the seed only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_value.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _cutter(rate: int, spm_rate: int, marks: tuple[str, str, str]):
    p, s, m = (mark.encode() for mark in marks)

    def cut(data: np.ndarray, h: list[int]) -> tuple[int, str, int | None, int | None, bytes]:
        ends = line_ends(data)
        n = len(ends)
        raw = data.tobytes()
        if not raw or any(mark in raw for mark in (p, s, m)) or h[2] % 100 >= rate:
            return n, PLAIN, None, None, raw
        a, b = (ends.select(units - 1) if units else 0 for units in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        spm = h[3] % 100 < spm_rate
        out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
        return n, SPM if spm else PSM, _characters(data[:a]), _characters(data[a:b]), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            numbers = list(zip(*[batch.column(c).to_pylist() for c in range(2, 6)], strict=True))
            for a, b in slices(offs):
                rows = [cut(data[offs[d] : offs[d + 1]], numbers[d]) for d in range(a, b)]
                n, form, prefix, middle, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    marks: tuple[str, str, str] = MARKS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id_column, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    A text is cut into its ``n`` lines, each with its line feed. Two cuts, drawn from the
    seed and the id, fall on any of the ``n + 1`` places before, between and behind lines;
    prefix, middle and suffix may each be empty. ``rate`` per cent of the texts are
    transformed, of these ``spm_rate`` per cent begin with the suffix. The other texts are
    ``plain``: their output is the text, the numbers of characters are null.

    A null text is empty. Empty texts and texts that hold a mark are plain. A null id draws
    like an empty one; repeated rows come out alike; an empty table gives no rows.
    """
    check_marks(marks)
    rows = pick(docs, id=id_column, text=text_column)
    drawn = rows.select("id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("id"), seed), 1)])
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return drawn.mapInArrow(_cutter(rate, spm_rate, marks), fields).withColumnRenamed("id", id_column)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from."""
    p, s, m = marks

    def parts(first: str, second: str) -> list[Column]:
        head, rest = (F.split_part(output, F.lit(second), F.lit(i)) for i in (1, 2))
        return [F.substr(head, F.lit(len(first) + 1)), *[F.split_part(rest, F.lit(m), F.lit(i)) for i in (1, 2)]]

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
