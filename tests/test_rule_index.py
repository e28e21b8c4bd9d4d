"""Rules found by grams against the plain scan."""

import random
import re

import pytest

from packsift.operators import rule_index
from packsift.operators.rule_index import gram_pattern, index_rules, necessary_texts, rule_grams, rule_parts, scan_indexed
from packsift.operators.scan import holds_text, scan, scan_regex
from packsift.plans.corpus import Corpus
from packsift.plans.job_runs import covering_rules, earlier_results
from tests.test_operators import plain, rule, rules


@pytest.mark.parametrize(
    ("pattern", "texts"),
    [
        (r"eval\(", [["eval("]]),
        (r"(?i)API_key\s*=", [["api_key", "="]]),
        (r"abc?d", [["ab", "d"]]),
        (r"ab+cd", [["ab", "bcd"]]),
        (r"ab*cd", [["a", "cd"]]),
        (r"ab{0,3}cd{2}e", [["a", "cd", "de"]]),
        (r"a{1}bc+?d", [["abc", "cd"]]),
        (r"one|t(?:w|)o|", [["one"], ["t", "o"], []]),
        (r"x(?:long text)y", [["x", "long text", "y"]]),
        (r"x(long)?y(?:ab|cd)z", [["x", "y", "z"]]),
        (r"^im[a-z]port\.os$", [["im", "port.os"]]),
        (r"[]a]bc[^]]d[\]]e", [["bc", "d", "e"]]),
        (r"aébc", [["a", "bc"]]),
        (r"\d+foo\wbar\b", [["foo", "bar"]]),
        (r"", [[]]),
    ],
)
def test_necessary_texts(pattern, texts):
    assert necessary_texts(pattern) == texts


@pytest.mark.parametrize("pattern", [r"(?=ab)c", r"(?<n>ab)", r"\x41bcd", r"\Qabc\E", r"(?i:ab)", r"a++b+*", r"(ab", r"ab)", r"[a&&b]", r"[a[b]]", r"\pL", r"a\1", "a{,3}", "ab\\", "*a", "(?s)abcd"])
def test_other_syntax_is_not_read(pattern):
    assert necessary_texts(pattern) is None and rule_grams(pattern) is None


def test_a_match_holds_all_necessary_texts():
    rng = random.Random(6)
    atoms = ["a", "b", "ab", "B", r"\.", ".", "[ab]", "(?:ab|b)", "(?:aba)", "(a)"]
    for _ in range(3000):
        pattern = "|".join("".join(rng.choice(atoms) + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 3)))
        alternatives = necessary_texts(pattern)
        for _ in range(12):
            text = "".join(rng.choice("abB.") for _ in range(rng.randrange(12)))
            if re.search(pattern, text):
                assert any(all(t in text.lower() for t in texts) for texts in alternatives), (pattern, text, alternatives)


def contents(rng):
    words = ["eval(", "exec", "Password", "import os", "token=", "naïve", "x" * 30, "日本", "a.b.c", "tokens", "passw0rd", "\t", "EVAL("]
    return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(12)))


def test_findings_equal_the_plain_scan(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(f"t{i}", rng.choice(["py", "js", None]), f"src/{i}.py", contents(rng)) for i in range(60)] + [("null", "py", "n", None), ("empty", "py", "e", "")]
    targets = spark.createDataFrame(rows, "identity string, ext string, path string, content string").repartition(3)
    corpus = rules(
        spark,
        rule("r.eval", r"eval\("), rule("r.any", r"(?i)eval\("), rule("r.pass", r"(?i)pass(?:word|w0rd)"), rule("r.alt", r"import os|token[s=]"), rule("r.short", r"os"),
        rule("r.anchor", r"^exec"), rule("r.end", r"exec$", languages=["python"]), rule("r.path", "token", path=r"src/1"), rule("r.look", r"(?=tok)token"), rule("r.look", r"(?<=t)oken"),
        rule("r.same", "import os"), rule("r.same", "import o"), rule("r.accent", "naïve|日本"), rule("r.dot", r"a\.b\.c"), rule("r.spaces", r"exec +exec", languages=["javascript"]),
    )
    expected = plain(scan_regex(targets, corpus, ["identity"]).collect())
    assert plain(scan_indexed(targets, corpus, ["identity"]).collect()) == expected and len(expected) > 100
    # Beyond the bounds grams are joined by a shuffle, and the rest goes batch by batch.
    monkeypatch.setattr(rule_index, "INDEX_ROWS", 3)
    batches = rule_index.rule_batches
    monkeypatch.setattr(rule_index, "rule_batches", lambda rest: batches(rest, max_rows=2))
    assert plain(scan_indexed(targets, corpus, ["identity"]).collect()) == expected


def test_ten_thousand_rules_in_one_read(spark, tmp_path):
    names = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in ("anda", "endo", "indu", "ondi", "unde") for c in range(200)]
    corpus = rules(spark, *[rule(f"r.{n}", rf"\b{n}\(") for n in names])
    assert corpus.count() == 10_000
    rng = random.Random(1)
    chosen = [(f"t{i}", "py", "\n".join(f"x = {rng.choice(names)}(1)" if rng.random() < 0.5 else "y = 2" for _ in range(20))) for i in range(50)]
    spark.createDataFrame(chosen, "identity string, ext string, content string").write.parquet(f"{tmp_path}/targets")
    found = scan(spark.read.parquet(f"{tmp_path}/targets"), corpus, ["identity"])
    expected = sorted((i, f"r.{m[1]}", n, n) for i, _, text in chosen for n, line in enumerate(text.split("\n"), 1) if (m := re.search(r"(\w+)\(", line)))
    assert plain(found.collect()) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan[^\n]*content", final)) == 1


def test_a_pattern_is_the_sum_of_its_parts():
    parts = rule_parts(r"(?i)Lo.ng text|x(?:a|b)|[|)]+@|")
    assert [(p["pattern"], p["text"]) for p in parts] == [("(?i)Lo.ng text", "ng text"), ("(?i)x(?:a|b)", "x"), ("(?i)[|)]+@", "@"), ("(?i)", "")]
    assert rule_parts("(?=a)b|c") == [{"pattern": "(?=a)b|c", "grams": [], "text": ""}]
    assert re.findall(gram_pattern(["abab", "baba", "ba.b", "(a|b"]), "ababab ba.b baxb (a|b") == ["abab", "baba", "abab", "ba.b", "(a|b"]


def test_what_rules_share_is_tried_once(spark):
    shared = [rule(f"r.{n}", rf"(?i)passage {n:03d}|copyright [0-9]+|[^ ]+@[^ ]+") for n in range(300)]
    corpus = rules(spark, *shared, shared[0], rule("r.whole", "passage 001"), rule("r.whole", "passage 001"), rule("r.js", "@", languages=["javascript"]))
    anchors, rest, _ = index_rules(corpus)
    assert (anchors.count(), rest.count()) == (302, 2)
    rows = [("a", "py", "Passage 007 Copyright 3 x@y\nnone @ all\nPASSAGE 001"), ("b", "js", "passage 001\n@")]
    targets = spark.createDataFrame(rows, "identity string, ext string, content string")
    found = plain(scan_indexed(targets, corpus, ["identity"]).collect())
    mail = [("a", f"r.{n}", 1, 1) for n in [*range(300), 0]]
    expected = [*mail, ("a", "r.1", 3, 3), ("b", "r.1", 1, 1), ("b", "r.whole", 1, 1), ("b", "r.js", 2, 2)]
    assert found == sorted(expected)


def test_only_texts_with_a_necessary_text_are_matched(spark):
    texts = ["x", "LICENSED UNDER", "Copyright", None, "", "a@b.org", "İcopyright"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    chosen = lambda pattern: [r["i"] for r in rows.where(holds_text("t", pattern)).orderBy("i").collect()]
    assert chosen("(?i)licensed under|copyright") == [1, 2, 6]
    assert chosen("[a-z]+@[a-z]+") == [5]
    assert holds_text("t", "[a-z]+|@") is None and holds_text("t", "(?=@)") is None


def test_earlier_results_scan_content_once(spark, sf_dir):
    corpus = Corpus(spark, sf_dir)
    plan = earlier_results(corpus, covering_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert corpus.store.table not in plan
