"""Near copies, recurring passages and benchmark items against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from packsift.llm import components, decontaminate, near_duplicates, repeated_phrases

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def edited(text, rng, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(prose):
    rng = random.Random(4)
    base = [prose(f"b{i}", n) for i, n in enumerate([12, 30, 60, 60, 150, 400, 900])]
    texts = []
    for t in base:
        texts += [t, t.upper(), t.replace(" ", "\n\t")] + [edited(t, rng, e) for e in (1, 1, 2, 3, 5, 8, 12, 20, 40) for _ in range(2)]
    passage = prose("shared", 45)
    texts += [f"{prose(f's{i}', 5 + 6 * i)} {passage} {prose(f'e{i}', 9)}" for i in range(25)]
    texts += [None, "", "  \n", "one", "One", "two words", "two  words", "a b c d", "a b c d e", "a b c", "a a a a a a a a a", "a a a a a"]
    rows = [(10 * i % 997, t) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "an id that is null " + prose("n", 30))]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components_agree_with_all_pairs(make_docs, corpus, k, percent):
    docs = make_docs(corpus, extra=("id", "cls", "a", "b", "key", "n"))
    found = Counter(tuple(r) for r in near_duplicates.jaccard_components(docs, k, percent).collect())
    null = [(i, t) for i, t in corpus if i is None]
    expected = brute_components([r for r in corpus if r[0] is not None], k, percent)
    expected.update([(None, len(shingles(t, k)), None) for _, t in null])
    assert found == expected


def test_a_hot_shingle_loose_groups_and_very_long_texts(make_docs, prose):
    """Copies of copies, so that a group holds many pairs that do not link; a phrase in every
    document; texts of 60,000 words that differ in few."""
    rng = random.Random(8)
    texts = []
    for g in range(3):
        own = [f"{prose(f'g{g}', 60)} the phrase that all of them have"]
        for _ in range(40):
            own.append(edited(rng.choice(own), rng, 2))
        texts += own
    texts += [f"{prose(f'u{i}', 3)} the phrase that all of them have" for i in range(60)]
    long = prose("long", 60_000, stock=5000)
    texts += [long, edited(long, rng, 300), edited(long, rng, 9000), long + " the phrase that all of them have"]
    rows = list(enumerate(texts))
    assert Counter(tuple(r) for r in near_duplicates.jaccard_components(make_docs(rows), 4, 85).collect()) == brute_components(rows, 4, 85)


def test_frequent_shingles_and_a_large_group_of_near_copies(make_docs, prose, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FREQUENT", 3)
    monkeypatch.setattr(near_duplicates, "COARSE", 100)
    rng = random.Random(9)
    t = prose("big", 120)
    rows = [(i, edited(t, rng, 1 + i % 7)) for i in range(150)] + [(200 + i, prose(f"o{i}", 40) + " " + prose("common", 20)) for i in range(40)]
    found = Counter(tuple(r) for r in near_duplicates.jaccard_components(make_docs(rows), 4, 85).collect())
    assert found == brute_components(rows, 4, 85)


def test_components_found_once_are_not_joined_anew(make_docs, prose, monkeypatch):
    """A driver that plans every round again holds more with each."""
    words = prose(9, 300).split()
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(40)]
    written = []
    for module in (near_duplicates, components):
        monkeypatch.setattr(module, "settle", lambda df, name, keep=module.settle: written.append(name) or keep(df, name))
    found = near_duplicates.jaccard_components(make_docs(rows), 4, 85)
    assert {r["component_id"] for r in found.collect()} == {0}
    # Behind the links of the last pairs: the components, and the round that leaves them as they are.
    last = len(written) - written[::-1].index("links")
    assert written[last:] == ["edges", "edges"]
    # No set is large, so what the bounds leave is written once a round.
    assert written.count("pairs") == written.count("links") == near_duplicates.STAR_ROUNDS + 1


def test_keys_of_all_classes_are_dealt_out_once_for_all_leaders(make_docs, prose, monkeypatch):
    """Each time moves a row for every key of every class, which is most of what the join moves."""
    words = prose(7, 120).split()
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i + 1 :]])) for i in range(12)]
    dealt = []

    def kept(df, name, keep=near_duplicates.settle):
        if re.search(r"Generate (explode|inline)\((keys|_extract_key)", df._jdf.queryExecution().optimizedPlan().toString()):
            dealt.append(name)
        return keep(df, name)

    monkeypatch.setattr(near_duplicates, "settle", kept)
    found = near_duplicates.jaccard_components(make_docs(rows), 4, 85)
    assert Counter(tuple(r) for r in found.collect()) == brute_components(rows, 4, 85)
    # Leaders of all rounds, tiles of more than one component, their rows.
    assert dealt == ["pairs", "mixed", "tiles"]


def test_a_finer_signature_takes_two_bits_for_a_shingle_at_most():
    for n in (1025, 1500, 2047, 2048, 2049, 60_000):
        own = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert n <= 8 * len(near_duplicates.fine_signature(own)) <= 2 * n


def test_one_document_of_each_group_stays(make_docs, corpus):
    docs = make_docs(corpus, extra=("r1", "row"))
    kept = near_duplicates.keep_one_of_each(docs).collect()
    rows = [r for r in corpus if r[0] is not None]
    groups = {least for (_, n, least) in brute_components(rows, 5, 80) if n}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None and shingles(r["text"], 5)) == sorted(groups)
    assert all(r["row"] == "own" for r in kept) and near_duplicates.keep_one_of_each(make_docs([])).count() == 0
    assert sum(not shingles(r["text"], 5) for r in kept) == sum(not shingles(t, 5) for _, t in corpus)


def test_no_documents(make_docs):
    assert near_duplicates.jaccard_components(make_docs([])).count() == 0
    assert repeated_phrases.remove_recurring(make_docs([])).count() == 0


def test_components_of_chains_and_cycles(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i * 3 + 7) % 20) for i in range(20)] + [(100 + i, 100 + (i + 4) % 20) for i in range(20)] + [(103, 102)] + [(300, 300)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges], "a long, b long")
    found = {r["node"]: r["root"] for r in components.connected(df).collect()}
    assert all(found[i] == 0 for i in range(61)) and 300 not in found
    root = list(range(20))
    for _ in range(20):
        for a, b in edges:
            if 100 <= a < 300:
                root[a - 100] = root[b - 100] = min(root[a - 100], root[b - 100])
    assert [found[100 + i] - 100 for i in range(20)] == root


def brute_recurring(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("window", [35, 10])
def test_recurring_passages_agree_with_counting_windows(make_docs, prose, window, monkeypatch):
    monkeypatch.setattr(repeated_phrases, "PASSAGES", 5)
    monkeypatch.setattr(repeated_phrases, "STRETCHES", 6)
    p, q = prose("p", 90), prose("q", 36)
    words = p.split()
    texts = [f"{prose(i, 20 + i)} {' '.join(words[i * 3 : 90 - i])} {prose(-i, 15)}" for i in range(14)]
    texts += [p + " " + p, q, q.replace(" ", "\n"), q.upper(), " ".join(q.split()[:34]), " ".join(q.split()[1:]), "a " * 80, "a " * 35, "a b " * 30]
    texts += [prose("x", 300), prose("x", 300), None, "", " \n ", "short"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, p), (None, None)]
    docs = make_docs(rows, extra=("r1", "seed", "at", "words"))
    found = Counter(tuple(r) for r in repeated_phrases.remove_recurring(docs, window).collect())
    assert found == brute_recurring(rows, window)


@pytest.fixture(scope="module")
def benchmark_rows(prose):
    return [(i, prose(f"item{i}", 12 + 2 * i)) for i in range(24)] + [(90, "too short to tell"), (91, None), (92, ""), (93, prose("item3", 18)), (None, prose("nullitem", 30))]


def test_items_are_found_up_to_edits_and_clean_documents_are_not(spark, make_docs, prose, benchmark_rows):
    rng = random.Random(5)
    rows, expected, near = [], {}, 0
    for i, t in benchmark_rows[:24]:
        n = len(t.split())
        variants = [t, t.upper().replace(" ", ", "), edited(t, rng, 1)] + [edited(t, rng, max(1, n // 10)) for _ in range(4)]
        for v in variants:
            expected[len(rows)] = i
            rows.append((len(rows), f"{prose(len(rows), 80)}. {v} ({prose(-len(rows), 60)})"))
    planted = len(rows)
    rows += [(planted + i, prose(f"clean{i}", 300)) for i in range(40)] + [(5000, None), (5001, ""), (5002, "too short to tell"), (0, rows[0][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in benchmark_rows], "item_id long, text string, key string")
    found = decontaminate.flag_contaminated(make_docs(rows, extra=("r1", "item", "key")), bench).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    assert all(not by_id[i]["contaminated"] and by_id[i]["items"] == [] for i in by_id if i >= planted)
    for i in range(planted):
        if i % 7 < 2:  # no edits in words
            assert expected[i] in by_id[i]["items"]
    assert sum(expected[i] in by_id[i]["items"] for i in range(planted)) >= decontaminate.RECALL * planted
    assert 93 in by_id[7 * 3]["items"]  # repeated items are found together
    kept = decontaminate.drop_contaminated(make_docs(rows, extra=("r1",)), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in by_id if not by_id[i]["contaminated"]} and "r1" in kept.columns


def test_whole_short_items_are_found_wherever_their_longest_word_is(spark, make_docs, prose):
    rows, items = [], []
    for n in range(8, 12):
        for at in range(n):
            for k in range(6):
                words = prose(f"short{n}.{at}.{k}", n).split()
                words[at] = f"longestword{at}"
                items.append((len(items), " ".join(words)))
                before, after = prose(f"b{len(items)}", 20), prose(f"a{len(items)}", 20)
                rows.append((len(rows), [f"{before} {items[-1][1]} {after}", items[-1][1]][k % 2]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r["items"] for r in decontaminate.flag_contaminated(make_docs(rows), bench).collect()}
    assert [i for i in range(len(items)) if i not in found[i]] == []


def test_no_items_or_no_documents(spark, make_docs, benchmark_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.flag_contaminated(make_docs([(1, "x y z")]), none).collect()] == [False]
    assert decontaminate.flag_contaminated(make_docs([]), bench).count() == 0


def test_edit_distance_agrees_with_the_table():
    rng = random.Random(6)
    for _ in range(200):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert decontaminate.edit_distance_within(p, t)[0] == best


def test_frequent_values_let_go_of_what_they_count():
    import tracemalloc

    import numpy as np

    held = [np.random.default_rng(i).integers(0, 1 << 16, 1 << 16).astype(np.uint64) for i in range(16)]
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    size = sum(x.nbytes for x in held)
    tracemalloc.start()
    found, often = near_duplicates.frequent(held, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and found.tolist() == values[counts >= 20].tolist() and often.tolist() == counts[counts >= 20].tolist()
    assert peak < 1.8 * size
    assert len(near_duplicates.frequent([np.arange(3, dtype=np.uint64)], 8)[0]) == 0
