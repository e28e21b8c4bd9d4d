"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on what is peculiar
to toxic text: words that recur there in several different contexts and hardly ever
in ordinary text. A text is cut into short windows; each is compressed with the ordinary
dictionary and with both together, and the bytes that the toxic one saves are the
window's signal. Mean and largest signal of a text are turned into a probability by a
logistic curve fitted on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packsift.llm.tables import pick

WINDOW_BYTES = 96
#: Bound of the labelled sample that is fitted on: rows of each label, and the longest
#: text among them.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 2000, 6000, 8000
ORDINARY_DICT, TOXIC_DICT = 8192, 1536
#: A word is peculiar to toxic text when it stands in so many different contexts there,
#: and so many times more often than in ordinary text.
CONTEXTS, TEXTS, TIMES = 8, 6, 10.0
#: Words are also looked at by so many first letters.
STEM = 5
THRESHOLD = 0.7


def windows(text: str, size: int = WINDOW_BYTES) -> list[bytes]:
    """Consecutive pieces of the lower-case text of ``size`` bytes or somewhat more,
    cut before a space where there is one within four sizes."""
    raw, out, at = text.lower().encode("utf-8", "replace"), [], 0
    while at < len(raw):
        end = raw.find(b" ", at + size, at + 4 * size)
        if end < 0:
            end = min(at + 4 * size, len(raw))
        out.append(raw[at:end])
        at = end
    return out


class Distance:
    """Signal of windows under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        parameters = z.ZstdCompressionParameters(
            strategy=z.STRATEGY_LAZY2, min_match=4, window_log=15, hash_log=14, chain_log=14, search_log=5,
            write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        self.compress = []
        for content in (ordinary, toxic + ordinary):
            dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            self.compress.append(z.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress)

    def features(self, text: str) -> tuple[float, float, float]:
        """Mean and largest signal, and the mean of what passes two bytes; zeros for an
        empty text."""
        plain, both = self.compress
        saved = [len(plain(w)) - len(both(w)) for w in windows(text)]
        if not saved:
            return 0.0, 0.0, 0.0
        n = len(saved)
        return sum(saved) / n, float(min(max(saved), 20)), sum(s - 2 for s in saved if s > 2) / n


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray  # intercept first

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -40, 40)))


def _trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a dictionary, without its entropy tables; too few samples to train
    on are a dictionary themselves."""
    import zstandard as z

    try:
        raw = z.train_dictionary(size, samples).as_bytes()
        # header: magic, id, tables; the content stands at the end
        return raw[min(len(raw) // 2, 256) :]
    except z.ZstdError:
        return b" ".join(samples)[-size:] or b" "


def _units(text: str) -> list[tuple[str, str]]:
    """Each word of the lower-case text twice: whole, and by its first letters."""
    words = re.findall(r"\w+", text.lower())
    return [(w, w[:STEM] + "*") for w in words]


def peculiar_words(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words and beginnings of words (ending in ``*``) of toxic texts. Several contexts
    and several texts are asked for, since near copies repeat whatever they hold.

    Units and contexts are numbers, and only units that may be peculiar are counted elsewhere:
    the driver fits, and would keep what a set of strings for each place takes."""
    number: dict[str, int] = {"": 0}
    none = np.zeros(0, np.int64)
    units, contexts, own = [none], [none], [none]
    for text in toxic:
        pairs = np.array([[number.setdefault(u, len(number)) for u in pair] for pair in _units(text)], np.int64).reshape(-1, 2)
        words = np.concatenate([[0], pairs[:, 0], [0]])
        units.append(pairs.ravel())
        contexts.append(np.repeat(words[:-2] << 32 | words[2:], 2))
        own.append(np.unique(pairs))
    unit, context = np.concatenate(units), np.concatenate(contexts)
    order = np.lexsort((context, unit))
    unit, context = unit[order], context[order]
    first = np.ones(len(unit), bool)
    first[1:] = (unit[1:] != unit[:-1]) | (context[1:] != context[:-1])
    n_contexts, n_texts = (np.bincount(x, minlength=len(number)) for x in (unit[first], np.concatenate(own)))
    often = (n_contexts >= CONTEXTS) & (n_texts >= TEXTS)
    texts = {u: int(n_texts[i]) for u, i in number.items() if often[i]}
    elsewhere: Counter = Counter()
    for text in ordinary:
        elsewhere.update({u for pair in _units(text) for u in pair if u in texts})
    rate = TIMES * max(len(toxic), 1) / max(len(ordinary), 1)
    return {u for u, n in texts.items() if n >= rate * (elsewhere[u] + 0.5)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression, intercept first, by Newton's method; ``weight``
    says how often each row counts."""
    n = np.ones(len(x)) if weight is None else weight
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """None when a label has fewer than two texts. Two texts of three train
    the dictionaries, the rest the curve; the lists should be in no meaningful order."""
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    for_curve = slice(0, None, 3)
    words_of = [t for i, t in enumerate(toxic) if i % 3], [t for i, t in enumerate(ordinary) if i % 3]
    words = peculiar_words(*words_of)
    kept = [" ".join(w for w, stem in _units(t) if w in words or stem in words) for t in words_of[0]]
    plain = [w for t in words_of[1] for w in windows(t, 200)]
    random.Random(8).shuffle(plain)
    model = Model(
        _trained(ORDINARY_DICT, plain[:8000]),
        _trained(TOXIC_DICT, [f" {t} ".encode() for t in kept if t]),
        np.zeros(4),
    )
    distance = Distance(model.ordinary, model.toxic)
    held = toxic[for_curve] + ordinary[for_curve]
    y = np.array([1.0] * len(toxic[for_curve]) + [0.0] * len(ordinary[for_curve]))
    model.weights = logistic(np.array([distance.features(t) for t in held]), y)
    return model


def learn(docs: DataFrame, labels: DataFrame, learnable, id_column: str, text_column: str, label_column: str) -> Model | None:
    """Fit on a bounded sample of the labelled rows: of each label the first by a hash
    of the id, so at most ``SAMPLE_TOXIC + SAMPLE_ORDINARY`` ids are broadcast and as many texts
    of at most ``SAMPLE_CHARS`` characters collected."""
    known = pick(labels, id=id_column, label=label_column).where(learnable(F.col("id")) & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    one = lambda label, most: known.where(F.col("label") == label).orderBy(*order).limit(most)
    chosen = one(1, SAMPLE_TOXIC).unionByName(one(0, SAMPLE_ORDINARY))
    texts = pick(docs, id=id_column, text=text_column).where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    # An id that repeats gives one text, so the sample stays bounded.
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).orderBy(*order)
    rows = found.select("text", "label").toArrow().to_pydict()
    by = lambda label: list(dict.fromkeys(t for t, x in zip(rows["text"], rows["label"], strict=True) if x == label))
    return fit(by(1), by(0))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    learnable=lambda doc_id: F.lit(True),
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    score_column: str = "toxicity",
) -> DataFrame:
    """All columns of ``docs`` and ``score_column``, the probability of label 1, in the
    place of a column of that name.

    ``learnable`` takes the id column and says which labelled rows may be learned
    from. Only the text is scored; null is the empty text, for which, as for any text
    without a signal, the curve gives its lowest values. Null and repeated ids are
    rows like others. With too few labels to learn from every score is 0.
    """
    model = learn(docs, labels, learnable, id_column, text_column, label_column)
    plain = docs.select(*[c for c in docs.columns if c.lower() != score_column.lower()])
    if model is None:
        return plain.withColumn(score_column, F.lit(0.0))
    schema = plain.schema.jsonValue()
    at = plain.columns.index(text_column)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic)
        for batch in batches:
            x = np.array([distance.features(t.as_py() or "") for t in batch.column(at)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*batch.schema.names, score_column])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return plain.mapInArrow(score, StructType([*StructType.fromJson(schema).fields, StructField(score_column, DoubleType())]))


def is_toxic(score: Column, threshold: float = THRESHOLD) -> Column:
    return score >= threshold
