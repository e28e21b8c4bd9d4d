import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from packsift.llm import periodic_runs
from packsift.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def brute(words, min_length=12):
    """All runs from comparing each word with the one q behind it, for every q."""
    found, taken = [], set()
    for q in range(1, len(words) // 2 + 1):
        start = 0
        for i in range(len(words) - q + 1):
            if i == len(words) - q or words[i] != words[i + q]:
                end = i + q
                if end - start >= max(min_length, 2 * q) and (start, end) not in taken:
                    taken.add((start, end))
                    found.append((start, end - start, q))
                start = i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def planted(rng):
    words = [rng.choice("abcdefgh") for _ in range(rng.randrange(10, 200))]
    for _ in range(rng.randrange(4)):
        a, p, n = rng.randrange(len(words)), rng.randrange(1, 20), rng.randrange(8, 90)
        words[a:a] = [words[(a + i % p) % len(words)] for i in range(n)]
    return words


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
@pytest.mark.parametrize("min_length", [2, 3, 6, 12])
def test_runs_of_random_words_agree_with_brute_force(letters, min_length):
    rng = random.Random(letters * 100 + min_length)
    docs = [[rng.choice("abcdefgh"[:letters]).encode() for _ in range(rng.randrange(90))] for _ in range(60)]
    found = periodic_runs.runs_of(docs, min_length)
    for d, words in enumerate(docs):
        rows = [(s, e - s, q) for s, e, q in found.get(d, np.zeros((0, 3), int)).tolist()]
        assert rows == brute(words, min_length), words


def test_runs_within_runs_and_shared_stretches():
    rng = random.Random(11)
    block = [b"x%d" % i for i in range(9)]
    nested = ([b"a", b"b"] * 8 + [b"c"]) * 5 + [b"a"] * 40 + ([b"d"] * 13 + [b"e"]) * 3
    docs = [
        nested, nested[:-3], nested[5:], block * 7, block * 7 + block[:4], [b"z"] * 1000, [w.encode() for w in fibonacci(400)],
        [], [b"one"], [bytes([97 + bin(i).count("1") % 2]) for i in range(512)],
        *[[w.encode() for w in planted(rng)] for _ in range(150)],
    ]
    found = periodic_runs.runs_of(docs)
    for d, words in enumerate(docs):
        rows = [(s, e - s, q) for s, e, q in found.get(d, np.zeros((0, 3), int)).tolist()]
        assert rows == brute(words), d
    # The same documents one by one give the same runs as in one grammar.
    for d in range(len(docs)):
        alone = periodic_runs.runs_of([docs[d]])
        assert alone.get(0, np.zeros((0, 3))).tolist() == found.get(d, np.zeros((0, 3))).tolist()


def test_the_grammar_derives_the_words():
    rng = random.Random(2)
    words = np.array([rng.randrange(5) for _ in range(700)] * 2 + [-1] + [rng.randrange(5)] * 300 + [-2, 3, -3])
    grammar = periodic_runs.compress_words(words, 5, np.array([0, 1401, 1702]))

    def derive(symbol):
        if symbol < 5:
            return [int(symbol)]
        return derive(grammar.left[symbol - 5]) + derive(grammar.right[symbol - 5])

    for symbol, place in zip(grammar.roots.tolist(), grammar.root_places.tolist(), strict=True):
        own = derive(symbol)
        assert words[place : place + len(own)].tolist() == own
    assert [len(derive(s)) for s in grammar.roots] == [1400, 300, 1]
    assert len(grammar.left) < 700 + 700  # the second copy is derived by the first one's rules


def test_documents(spark, make_docs, prose):
    rng = random.Random(4)
    texts = [
        None, "", "  \n ", "one", "a " * 11, "a " * 12, "é ü\n" * 6, "A a " * 6, "x\x1cy " * 20, "nbsp x " * 12,
        prose(1, 900) + " so it goes" * 9 + " " + prose(2, 300), " ".join(planted(rng)), " ".join(planted(rng)), "a b c d e f " * 2, "a b c d e f " * 2, "a b c d e f g a b c d e f g",
    ]
    rows = [*enumerate(texts), (None, "b " * 30), (3, "again " * 14)]
    docs = make_docs(rows, extra=("runs", "collapsed", "start", "id"))
    found = periodic_runs.find_runs(docs).collect()
    expected = [(i, [(*r,) for r in brute(split(t))], kept(split(t), brute(split(t)))) for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([(r["doc_id"], [(*x,) for x in r["runs"]], r["collapsed"]) for r in found], key=order) == sorted(expected, key=order)
    assert periodic_runs.find_runs(make_docs([])).count() == 0


def test_long_texts_of_few_words_take_little_time():
    rng = random.Random(8)
    phrase = [b"p%d" % i for i in range(6)]
    hot = [w for i in range(25_000) for w in (*phrase, b"n%d" % rng.randrange(10**6))]
    docs = [[b"a"] * 300_000, [w.encode() for w in fibonacci(100_000)], hot]
    found = periodic_runs.runs_of(docs)
    assert found[0].tolist() == [[0, 300_000, 1]]
    assert 2 not in found or len(found[2]) < 5
    assert len(found[1]) > 10_000


def brute_of_numbers(ids, min_length=12):
    """As ``brute``, a period at a time in numpy."""
    found, taken = [], set()
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for start, end in edges[edges[:, 1] - edges[:, 0] + q >= max(min_length, 2 * q)].tolist():
            if (start, end + q) not in taken:
                taken.add((start, end + q))
                found.append((start, end + q - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_query_agrees_with_brute_force_on_all_documents(spark, sf_dir):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = {}
    for row in table:
        words, h = split(row["text"]), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        runs = brute_of_numbers(np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int))
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
        exponent = 1000 * best[1] // best[2] if runs else None
        expected[row["doc_id"]] = (len(runs), *best, exponent, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept(words, runs)))
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert found == expected
    assert sum(r[0] > 0 for r in expected.values()) > len(expected) // 20
