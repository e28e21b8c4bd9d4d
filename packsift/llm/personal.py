"""Personal data by weak supervision.

Fixed patterns find the base spans, which always count. Wider patterns propose further
spans. On every candidate, base or proposed, labelers vote for, against, or not at all: patterns,
gazetteers of names that precede such data and of host endings, and the words around. Votes are
counted over all documents by pattern of votes; expectation-maximisation estimates from
those counts how reliable each labeler is and how likely each pattern is personal.
On these likelihoods a classifier of spans is trained from features of form and
surroundings, and decides on the proposed spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.llm.tables import pick, settle
from packsift.llm.toxicity import logistic

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Wider patterns, which only propose.
PROPOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9.])(?:[0-9]{1,3}(?:\.|\[\.\]| \. )){3}[0-9]{1,3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}[ .-][0-9]{4}[ .-][0-9]{4}[ .-][0-9]{2,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
}
_HAS_AT = re.compile(r"(?:\(|\[| )at(?:\)|\]| )")

#: Gazetteers: words that announce data of a kind, and endings of host names.
ANNOUNCE = {
    "email": {"mail", "email", "e-mail", "contact", "write", "courriel", "correo", "kontakt"},
    "ip": {"ip", "host", "server", "address", "login", "client", "gateway"},
    "card": {"card", "visa", "credit", "payment", "iban", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "cell"},
}
REFUSE = {"version", "v", "release", "build", "section", "chapter", "isbn", "issn", "figure", "table", "id", "no", "nr"}
ENDINGS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"}

LABELERS = 6
FEATURES = 8
CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, found from each @ backwards: what stands before a match is
    the longest run of its characters, unless an earlier match ends within it."""
    at, free, match = text.find("@"), 0, BASE["email"].match
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = match(text, start) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)``, ordered by start, then kind; code points."""
    spans = [(a, b, 0) for a, b in _emails(text)]
    for m in BASE["ip"].finditer(text):
        if all(len(p) <= 10 and int(p) <= 255 or not p.strip("0") or int(p.lstrip("0")[:4]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            spans.append((m.start(), m.end(), 1))
    for m in BASE["card"].finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in BASE["phone"].finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the wider patterns that overlap no base span of their kind."""
    out = []
    for kind, name in enumerate(KINDS):
        if name == "email" and not _HAS_AT.search(text):
            continue
        taken = [s for s in base if s[2] == kind]
        starts = [s[0] for s in taken]
        for m in PROPOSE[name].finditer(text):
            i = bisect_left(starts, m.end())
            if not (i and taken[i - 1][1] > m.start()):
                out.append((m.start(), m.end(), kind))
    return out


def votes_and_features(text: str, start: int, end: int, kind: int) -> tuple[list[int], list[int]]:
    """Votes (1, -1, 0: none) of the labelers, and features (0 or 1)."""
    name, span = KINDS[kind], text[start:end]
    before = re.findall(r"[\w-]+", text[max(0, start - CONTEXT) : start].lower())[-4:]
    after = re.findall(r"[\w-]+", text[end : end + CONTEXT].lower())[:3]
    near = {*before, *after}
    digits = _digits(span)
    exact = BASE[name].fullmatch(span) is not None
    if name == "email":
        form = span.count("@") == 1 or bool(re.search(r"\bat\b", span))
        check = re.split(r"\W+", span.lower())[-1] in ENDINGS
    elif name == "ip":
        form = all(int(p) <= 255 for p in re.findall(r"[0-9]{1,9}", span))
        check = not digits.startswith("0")
    elif name == "card":
        form = 14 <= len(digits) <= 19
        check = luhn(digits)
    else:
        form = 10 <= len(digits) <= 15
        check = span.startswith("+") or span.startswith("(")
    edge = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    numbers = sum(w.isdigit() for w in near)
    announced = any(w in ANNOUNCE[name] for w in before)
    other = any(w in words for kind_, words in ANNOUNCE.items() if kind_ != name for w in before)
    refused = any(w in REFUSE for w in before[-2:])
    votes = [
        1 if exact else 0,  # the pattern
        1 if form else -1,  # number of digits, parts
        1 if check else (-1 if name == "card" else 0),  # checksum, host ending, country code
        1 if announced else (-1 if other and not exact else 0),  # announcing words
        -1 if refused else 0,  # words that announce other numbers
        -1 if edge or numbers > 3 else 0,  # part of a longer word, or of a table of numbers
    ]
    features = [exact, form, check, announced, refused, edge, numbers > 1, len(span) > 16]
    return votes, [int(f) for f in features]


def _codes(text: str, start: int, end: int, kind: int) -> tuple[int, int]:
    votes, features = votes_and_features(text, start, end, kind)
    v = 0
    for x in votes:
        v = v * 3 + x + 1
    f = 0
    for x in features:
        f = f * 2 + x
    return v, f


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())])
    for batch in batches:
        rows = []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            found = [(*s, True) for s in base] + [(*s, False) for s in proposals(text, base)]
            out = []
            for start, end, kind, is_base in found:
                v, f = _codes(text, start, end, kind)
                out.append({"start": start, "end": end, "kind": kind, "base": is_base, "votes": v, "features": f})
            rows.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["id", "spans"])


_SPANS = "array<struct<start:int, end:int, kind:int, base:boolean, votes:int, features:int>>"


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability that each pattern of votes (rows; -1, 0, 1) is personal data.

    Labelers are independent given the truth (Dawid and Skene): each has, for either truth,
    probabilities of its three answers. Started from the majority of votes.
    """
    p = np.clip(0.5 + votes.sum(axis=1) / (2 * votes.shape[1]), 0.05, 0.95)
    answers = np.stack([votes == a for a in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeler, answer
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        logs = []
        for weight in (n * p, n * (1 - p)):
            rate = np.einsum("i,ija->ja", weight, answers) + 1.0
            rate /= rate.sum(axis=1, keepdims=True)
            logs.append(np.einsum("ija,ja->i", answers, np.log(rate)))
        odds = np.log(prior / (1 - prior)) + logs[0] - logs[1]
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def accepted_features(counted: list[tuple[int, int, int, int]]) -> set[tuple[int, int]]:
    """``(kind, features)`` that the trained classifier takes for personal data, from
    counts ``(kind, votes, features, n)`` over all documents."""
    out: set[tuple[int, int]] = set()
    for kind in range(len(KINDS)):
        rows = [r for r in counted if r[0] == kind]
        if not rows:
            continue
        votes = np.array([[r[1] // 3**j % 3 - 1 for j in range(LABELERS - 1, -1, -1)] for r in rows])
        n = np.array([r[3] for r in rows], float)
        p = expectation_maximisation(votes, n)
        x = np.array([[r[2] >> j & 1 for j in range(FEATURES - 1, -1, -1)] for r in rows], float)
        # each row counts n * p times for, n * (1 - p) times against
        w = np.concatenate([n * p, n * (1 - p)])
        weights = logistic(np.concatenate([x, x]), np.concatenate([np.ones(len(x)), np.zeros(len(x))]), ridge=1.0, weight=w)
        score = weights[0] + x @ weights[1:]
        out |= {(kind, r[2]) for r, s in zip(rows, score, strict=True) if s >= 0}
    return out


def find_personal(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id_column, spans)`` for every row: ``spans`` is an array of structs ``start, end,
    kind, base`` ordered by start, then kind; code points, end exclusive.

    A null or empty text has no spans. Null and repeated ids are rows like others, and
    repeated rows are counted like others. What reaches the driver are counts by kind,
    pattern of votes and features, of which there are a fixed number.
    """
    rows = pick(docs, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()
    found = settle(rows.mapInArrow(_candidates, f"id {kind}, spans {_SPANS}"), "spans")
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").count().collect()
    accepted = accepted_features([(r["kind"], r["votes"], r["features"], r["count"]) for r in counted])
    known = F.array(*[F.lit(k * 256 + f) for k, f in sorted(accepted)]).cast("array<int>")
    kept = F.filter("spans", lambda s: s["base"] | F.array_contains(known, s["kind"] * 256 + s["features"]))
    ordered = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))
    return found.select(F.col("id").alias(id_column), ordered.alias("spans"))
