"""Token counts from counts of distinct pieces; ids of a document are never made.

A piece is a stretch of text that starts at the beginning of the text or at a single
space between two characters that are no white space. A byte-level pre-tokenizer
always cuts there, so the tokens of a text are those of its pieces. Pieces are counted
once each, by the library itself. The most frequent pieces (a bounded list) are joined
to the documents in place, the others through a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.llm.library import loaded
from packsift.llm.tables import pick, settle

#: At most so many frequent pieces, of at most so many bytes each, go to every task.
HEAD_PIECES = 1 << 18
HEAD_PIECE_BYTES = 64
#: A task reports a piece as frequent when it met it so often in a stretch of so many; longer
#: pieces are not counted.
FREQUENT, STRETCH = 2, 1 << 20
ENCODE_ROWS = 1024
#: Documents whose pieces are held at a time.
MEASURE_ROWS = 128

_IRREGULAR = re.compile(r" \s|\s |^\s|\s$")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """The pieces of a text; joined, they are the text."""
    if not text:
        return []
    parts = _CUT.split(text) if _IRREGULAR.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def parts(piece: str) -> list[str]:
    """A piece without its last comma or full stop, and that mark: after a letter or
    digit (of the first blocks, for which all versions of Unicode agree) the pre-tokenizer cuts."""
    if len(piece) > 1 and piece[-1] in ".," and piece[-2] < "\u0250" and piece[-2].isalnum():
        return [piece[:-1], piece[-1]]
    return [piece]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    met = 0

    def report() -> pa.RecordBatch:
        often = [(p, n) for p, n in seen.items() if n >= FREQUENT]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], names=["piece", "n"])

    for batch in batches:
        for text in batch.column(0):
            found = pieces(text.as_py() or "")
            seen.update([p for p in found if len(p) <= HEAD_PIECE_BYTES])
            met += len(found)
            if met >= STRETCH:
                yield report()
                seen, met = Counter(), 0
    yield report()


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                found = tokenizer.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.ids) for x in found], pa.int64())], names=["piece", "n_tokens"])

    return encode


def piece_counts(distinct: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(piece, n_tokens)`` for a table of distinct pieces."""
    return distinct.select("piece").mapInArrow(_encoder(tokenizer_path), "piece string, n_tokens long")


def _bounded(ranked: DataFrame, most: int) -> DataFrame:
    """Pieces with the largest counts, at most ``most``: whole classes of counts (eighths
    of a doubling) from the top, found from the sizes of all classes."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(ranked.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return ranked.where(F.lit(False) if least is None else level >= least)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row of ``docs``, under the name of
    ``id_column``: length in UTF-8 bytes and number of tokens without added special
    tokens; special strings in a text count as the library takes them.

    A null text is empty: 0 and 0. Null and repeated ids are rows like others.
    """
    rows = pick(docs, id=id_column, text=text_column)
    ranked = rows.select("text").mapInArrow(_frequent, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    head_rows = piece_counts(_bounded(settle(ranked, "pieces"), HEAD_PIECES), tokenizer_path).toArrow()
    head = dict(zip(head_rows.column("piece").to_pylist(), head_rows.column("n_tokens").to_pylist(), strict=True))

    kind = rows.schema["id"].dataType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, MEASURE_ROWS):
                yield from rows_of(whole.slice(start, MEASURE_ROWS))

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, names_, counts, sums = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            found = pieces(text.as_py() or "")
            rest = [x for p in found if p not in head for x in parts(p)]
            sums.append(sum([head.get(p, 0) for p in found]) + sum([head.get(x, 0) for x in rest]))
            rest = Counter([x for x in rest if x not in head])
            keys += [key] * len(rest)
            names_ += rest.keys()
            counts += rest.values()
        n, rare = batch.num_rows, len(keys)
        ids, sizes = batch.column(1), batch.column(2)
        names = ["row", "id", "n_bytes", "piece", "n"]
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, sizes, pa.nulls(n, pa.string()), pa.array(sums, pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.nulls(rare, ids.type), pa.nulls(rare, pa.int64()), pa.array(names_, pa.string()), pa.array(counts, pa.int64())],
            names=names,
        )

    # The row number is made and written once; nothing computes it again.
    numbered = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text"
    )
    measured = settle(
        numbered.mapInArrow(measure, f"row long, id {kind.simpleString()}, n_bytes long, piece string, n long"), "pieces"
    )
    rare = measured.where(F.col("piece").isNotNull()).select("row", "piece", "n")
    base = measured.where(F.col("piece").isNull()).select("row", "id", "n_bytes", "n")
    distinct = piece_counts(rare.select("piece").distinct(), tokenizer_path)
    summed = rare.join(distinct, "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("rest"))
    return base.join(summed, "row", "left").select(
        F.col("id").alias(id_column), "n_bytes", (F.col("n") + F.coalesce("rest", F.lit(0).cast("long"))).alias("n_tokens")
    )
