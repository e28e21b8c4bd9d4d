"""Language by multinomial naive Bayes over hashed character n-grams.

Counts of the n-grams of every learned text are summed per language and bucket, first
in the task, then by Spark. The matrix of log-probabilities has a fixed number of
buckets and goes to every task; a batch of texts is scored as a sparse matrix of
(text, bucket) entries times that matrix, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.llm.tables import pick

LOG2_BUCKETS = 15
SIZES = (1, 2, 3)
SMOOTHING = 0.5
SLICE_CHARS = 1 << 18
UNDETERMINED = "und"

_KNOWN = np.zeros(0x110000, np.uint8)  # 1: no letter, 2: letter, 0: not looked up


def _letters(points: np.ndarray) -> np.ndarray:
    state = _KNOWN[points]
    if (state == 0).any():
        for p in np.unique(points[state == 0]).tolist():
            _KNOWN[p] = 2 if chr(p).isalpha() else 1
        state = _KNOWN[points]
    return state == 2


def text_parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts in groups of bounded size: code points of lower-case letters with one
    space between words, and the number of the text of each. A long text comes in
    stretches that overlap by the longest n-gram less one."""
    group, owner, size = [], [], 0
    overlap = max(SIZES) - 1

    def flush():
        points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
        who = np.repeat(np.array(owner), [len(g) for g in group])
        letter = _letters(points)
        points = np.where(letter, points, 32)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each word
        keep[1:] |= who[1:] != who[:-1]
        return points[keep], who[keep]

    for i, text in enumerate(texts):
        low = text.lower()
        for at in range(0, max(len(low) - overlap, 1), SLICE_CHARS):
            piece = low[at : at + SLICE_CHARS + overlap]
            group.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= SLICE_CHARS:
                yield flush()
                group, owner, size = [], [], 0
    if group:
        yield flush()


def buckets(points: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of every n-gram that holds a letter, and its text."""
    letter = points != 32
    h = np.zeros(len(points), np.uint64)
    grown = np.zeros(len(points), bool)
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            m = len(points) - n + 1
            if m <= 0:
                return
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
            grown = grown[:m] | letter[n - 1 :]
            if n in SIZES:
                ok = grown & (who[:m] == who[n - 1 :])
                mixed = (h[ok] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
                yield ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - LOG2_BUCKETS)).astype(np.int64), who[:m][ok]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    texts_of: dict[str, int] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        names, code = np.unique(langs.astype(str), return_inverse=True)
        for j, name in enumerate(names):
            texts_of[name] = texts_of.get(name, 0) + int((code == j).sum())
            sums.setdefault(name, np.zeros(1 << LOG2_BUCKETS, np.int64))
        for points, who in text_parts(texts):
            for bucket, doc in buckets(points, who):
                flat = np.bincount(code[doc] * (1 << LOG2_BUCKETS) + bucket, minlength=len(names) << LOG2_BUCKETS).reshape(len(names), -1)
                for j, name in enumerate(names):
                    sums[name] += flat[j]
    for name, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], texts_of[name]))],
            names=["lang", "bucket", "n"],
        )


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (buckets x languages) and log-priors from all rows
    ``(lang, text)``. What is collected is bounded by languages times buckets."""
    counted = docs.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    column = np.searchsorted(np.array(names, object), np.array(rows.column("lang").to_pylist(), object)) if names else np.zeros(0, int)
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    counts, texts = np.zeros((1 << LOG2_BUCKETS, len(names))), np.zeros(len(names))
    seen = bucket >= 0
    counts[bucket[seen], column[seen]] = n[seen]
    texts[column[~seen]] = n[~seen]
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (1 << LOG2_BUCKETS)))
    return names, logs.astype(np.float32), np.log(texts / max(texts.sum(), 1)) if names else texts


def identify(
    docs: DataFrame,
    learnable,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """``(id_column, lang_pred, score)`` for every row of ``docs``.

    ``learnable`` takes the id column and says which rows may be learned from; of these
    the ones with a language count. The score is the posterior probability of the
    prediction; of equal languages the first by name is taken. A null text, or one
    without a letter, is ``und`` with score 0, as is every text when there was nothing
    to learn from. Null and repeated ids are rows like others.
    """
    rows = pick(docs, id=id_column, text=text_column, lang=lang_column)
    names, logs, priors = train(rows.where(learnable(F.col("id")) & F.col("lang").isNotNull()))
    kind = rows.schema["id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            total = np.tile(priors, (len(texts), 1))
            grams = np.zeros(len(texts), np.int64)
            for points, who in text_parts(texts):
                first = int(who[0]) if len(who) else 0
                for bucket, doc in buckets(points, who):
                    local = doc - first
                    grams += np.bincount(doc, minlength=len(texts))
                    for j in range(len(names)):
                        part = np.bincount(local, weights=logs[bucket, j])
                        total[first : first + len(part), j] += part
            if names:
                best = total.argmax(axis=1)
                score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            seen = grams > 0 if names else np.zeros(len(texts), bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([names[best[i]] if seen[i] else UNDETERMINED for i in range(len(texts))], pa.string()), pa.array([float(score[i]) if seen[i] else 0.0 for i in range(len(texts))], pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    return rows.select("id", "text").mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)

