"""Language, toxicity and personal data."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packsift.llm import language, personal, toxicity
from packsift.llm.tables import fold

LANGS = {"aa": "kol mira tesu vano", "bb": "xrit gwel zbro qunt", "cc": "èlo çava ñuro öst"}


def sentence(lang, rng, n=30):
    stems = LANGS[lang].split()
    return " ".join(rng.choice(stems) + rng.choice(stems)[:2] for _ in range(n))


def test_held_out_languages_and_undetermined_texts(make_docs):
    rng = random.Random(1)
    rows = [(i, sentence(lang, rng), lang, "s") for i, lang in enumerate(list(LANGS) * 60)]
    odd = [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 -- 4", "bb", "s"), (1003, sentence("bb", rng), None, None), (None, sentence("cc", rng), "cc", "s"), (7, rows[7][1], "bb", "s")]
    long = (1004, sentence("aa", rng, 60000), None, None)
    docs = make_docs(rows + odd + [long], extra=("id", "bucket"))
    found = language.identify(docs, lambda i: fold(i, 5) != 0).collect()
    assert len(found) == len(rows) + len(odd) + 1
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang, _ in rows if i != 7)
    assert [by_id[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und", "und", "und", "bb", "aa", "cc"]
    assert all(0 <= r["score"] <= 1 for r in found)


def test_nothing_to_learn_languages_from(make_docs):
    assert [r["lang_pred"] for r in language.identify(make_docs([(1, "some text")]), lambda i: F.lit(True)).collect()] == ["und"]
    assert language.identify(make_docs([]), lambda i: F.lit(True)).count() == 0


def test_long_texts_count_the_same_ngrams_as_short_ones(monkeypatch):
    rng = random.Random(3)
    texts = [sentence("cc", rng, 400), "", "x"]

    def counts():
        out = np.zeros(1 << language.LOG2_BUCKETS, int)
        for points, who in language.text_parts(texts):
            for bucket, _ in list(language.buckets(points, who))[-1:]:
                out += np.bincount(bucket, minlength=len(out))
        return out

    whole = counts()
    monkeypatch.setattr(language, "SLICE_CHARS", 100)
    assert abs(counts() - whole).sum() <= 0.01 * whole.sum()


@pytest.fixture(scope="module")
def labelled(prose):
    rng = random.Random(2)
    slurs = ["vorbul", "skazzle", "gritmo", "plonkard"]
    rows, labels = [], []
    for i in range(400):
        words = prose(f"t{i}", rng.randrange(40, 160)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(4, 9)):
                words.insert(rng.randrange(len(words)), rng.choice(slurs))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_peculiar_words_agree_with_sets_of_places_and_take_less(prose):
    rng = random.Random(5)
    ordinary = [prose(f"o{i}", 120) for i in range(60)] + [""]
    toxic = ["", "vorbul"]
    for i in range(60):
        words = prose(f"t{i}", 400, stock=4000).split()
        for slur in ("Vorbul", "skazzle", "skazzled", f"gritmo{i}"):
            words.insert(rng.randrange(len(words)), slur)
        toxic.append(" ".join(words))

    def plain():
        places, texts, elsewhere = set(), Counter(), Counter()
        for text in toxic:
            words = re.findall(r"\w+", text.lower())
            units = [(w, w[: toxicity.STEM] + "*") for w in words]
            places |= {(u, b, a) for pair, b, a in zip(units, ["", *words], [*words[1:], ""], strict=False) for u in pair}
            texts.update({u for pair in units for u in pair})
        for text in ordinary:
            elsewhere.update({u for w in re.findall(r"\w+", text.lower()) for u in (w, w[: toxicity.STEM] + "*")})
        contexts = Counter(u for u, _, _ in places)
        rate = toxicity.TIMES * len(toxic) / len(ordinary)
        return {u for u, n in contexts.items() if n >= toxicity.CONTEXTS and texts[u] >= toxicity.TEXTS and texts[u] >= rate * (elsewhere[u] + 0.5)}, 2 * sum(len(t.split()) for t in toxic)

    expected, places = plain()
    assert {"vorbul", "vorbu*", "skazzle", "skazz*", "gritm*"} <= expected
    tracemalloc.start()
    try:
        found = toxicity.peculiar_words(toxic, ordinary)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == expected
    assert peak < 120 * places


def test_held_out_toxicity(spark, make_docs, labelled):
    rows, labels = labelled
    odd = [(5000, None), (5001, ""), (None, rows[0][1]), (4, rows[4][1]), (5002, rows[1][1] * 40)]
    table = spark.createDataFrame([*labels, (None, 1, 1), (9000, 1, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_documents(make_docs(rows + odd, extra=("label", "score")), table, lambda i: fold(i, 3) != 1).collect()
    assert len(scored) == len(rows) + len(odd) and all(0 <= r["toxicity"] <= 1 for r in scored)
    by_id = {r["doc_id"]: r["toxicity"] for r in scored}
    held = {i for i, *_ in labels}
    right = sum((by_id[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in labels)
    assert right >= 0.97 * len(held)
    assert by_id[5000] == by_id[5001] < 0.5 and by_id[5002] < 0.5


def test_no_labels_of_one_kind(spark, make_docs):
    table = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["toxicity"] for r in toxicity.score_documents(make_docs([(1, "a"), (2, None)]), table).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(make_docs([]), table).count() == 0


def plain_base(text):
    out = []
    for kind, (name, pattern) in enumerate(personal.BASE.items()):
        for m in pattern.finditer(text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if name == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and personal.luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_agree_with_the_patterns():
    rng = random.Random(11)
    parts = ["a.b@x.de", "@", "x@y", "q@-.a.b", "1.2.3.4", "256.1.1.1", "0000000255.1.2.3", "4111 1111 1111 1111", "4111-1111 1111-1112", "+1 (578) 555-6437", "+49 30 1234567", "+", "é", " ", "..", "12", "0", "..@a.b", "\n", "٣", "a@b.c@d.e", "%+-_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert personal.base_spans(text) == plain_base(text), text


def test_base_stays_and_the_trained_classifier_adds(make_docs):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        phone = f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"please call +1 {phone} or write to u{i}@mail.com from 10.0.0.{i}"))
        rows.append((1000 + i, f"phone {phone} 4918187128635271"))
        rows.append((2000 + i, f"see version 1.2.3.{300 + i} of isbn 123 456 7890"))
    rows += [(5000, None), (5001, ""), (None, "mail a@b.de"), (0, rows[0][1]), (5002, "x " * 50000 + "z@y.fr")]
    found = personal.find_personal(make_docs(rows, extra=("id", "spans", "kind"))).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    added = 0
    for r in found:
        spans = [(s["start"], s["end"], s["kind"]) for s in r["spans"]]
        base = [(s["start"], s["end"], s["kind"]) for s in r["spans"] if s["base"]]
        assert base == plain_base(texts[r["doc_id"]] or "") and spans == sorted(spans, key=lambda s: (s[0], s[2]))
        added += len(spans) - len(base)
        if r["doc_id"] is not None and 2000 <= r["doc_id"] < 3000:
            assert spans == []
    assert added >= 100
    assert personal.find_personal(make_docs([])).count() == 0


def test_reliabilities_favour_labelers_that_agree():
    votes = np.array([[1, 1, 1], [-1, -1, -1], [1, 1, -1], [-1, -1, 1]])
    p = personal.expectation_maximisation(votes, np.array([40.0, 40.0, 20.0, 20.0]))
    assert p[0] > 0.9 and p[1] < 0.1 and p[2] > 0.5 > p[3]
