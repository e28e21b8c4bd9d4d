import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from packsift.llm import fill_in_middle as fim


def plainly(doc_id, text, seed=7, rate=100, spm_rate=50):
    """The example of one text, without any set of boundaries."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "é\nüñ\n日本\n🙂", " \r\n\t\n", "with <P> inside\nx", "a <S", "<M>", "x<\nP>\n<\nS>",
    "line\n" * 30, "<P\n><P\nS>\n", "very long " * 30_000 + "\nend\n", "\n" * 200_000, "ab\n" * 100_000, "same\n", "same\n",
]


def test_examples_agree_with_plain_cutting_and_are_restored(spark, make_docs):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(["a", "é", "\n", "<", "P>"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no id\nat all\n"), (None, None)]
    docs = make_docs(rows, extra=("n", "h1", "form", "output"))
    for settings in ({}, {"seed": 3, "rate": 40, "spm_rate": 80}):
        found = fim.fill_in_middle(docs, **settings).withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect()
        assert len(found) == len(rows)
        for r in found:
            candidates = [texts[r["doc_id"]]] if r["doc_id"] is not None else ["no id\nat all\n", None]
            seen = (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
            assert seen in [plainly(r["doc_id"], t, **settings) for t in candidates]
            assert r["text"] in [t or "" for t in candidates]
        assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(make_docs([])).count() == 0


@pytest.mark.parametrize(
    ("members", "kinds"),
    [
        (range(5, 400_000, 37), {fim.ArrayContainer}),
        (range(1, 200_001), {fim.RunContainer}),
        (range(3, 300_000, 3), {fim.BitmapContainer}),
        ([*range(100), *range(70_000, 135_000, 2), 1 << 20, (1 << 33) + 7], {fim.ArrayContainer, fim.RunContainer, fim.BitmapContainer}),
        ([9], {fim.ArrayContainer}),
        ([], set()),
    ],
)
def test_select_in_each_kind_of_container(members, kinds):
    members = np.array(list(members), np.int64)
    found = fim.BoundarySet(members)
    assert len(found) == len(members) and {type(c) for c in found.containers} == kinds
    for k in {*range(min(200, len(members))), *range(0, len(members), 997), len(members) - 1} - {-1}:
        assert found.select(k) == members[k]


@pytest.mark.parametrize("marks", [("<P>", "<S>", "<P>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<P>", "<", "m"), ("", "a", "b")])
def test_marks_that_may_overlap_are_refused(spark, make_docs, marks):
    with pytest.raises(ValueError):
        fim.fill_in_middle(make_docs([]), marks=marks)


def test_other_marks(spark, make_docs):
    marks = ("[prefix]", "[suffix]", "[end-middle]")
    docs = make_docs([(i, f"a{i}\n<P>b\nc\nd") for i in range(20)])
    found = fim.fill_in_middle(docs, marks=marks).select("doc_id", "form", fim.restored(F.col("output"), F.col("form"), marks).alias("text")).collect()
    assert all(r["text"] == f"a{r['doc_id']}\n<P>b\nc\nd" and r["form"] != "plain" for r in found)
