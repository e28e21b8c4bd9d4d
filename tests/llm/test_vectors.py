import math

import numpy as np
from pyspark.sql import functions as F

from packsift.llm import vectors
from packsift.llm.queries import QUERIES


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = min(v, usable.get(i, v))
    found = {}
    for q in [i for i in usable if i % 20 == 0]:
        scores = sorted((-sum(np.float32(a).astype(float) * np.float32(b).astype(float) for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
        found[q] = [(i, -s) for s, i in scores[:k]]
    return found


def run(spark, rows, k=20, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string")
    out = {}
    for r in vectors.nearest(df, lambda i: i % 20 == 0, k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores_on_random_vectors_in_many_cells(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(24) * rng.uniform(0.5, 2)], "x") for i in range(600)]
    found, expected = run(spark, rows, vector_block=100, query_block=7), brute([r[:2] for r in rows], 20)
    hits = total = 0
    assert found.keys() == expected.keys()
    for q, best in expected.items():
        got = dict(found[q])
        assert len(found[q]) == 20 and q not in got
        hits += len(got.keys() & dict(best).keys())
        total += 20
        assert all(math.isclose(got[i], s, rel_tol=1e-12, abs_tol=1e-12) for i, s in best if i in got)
    assert hits / total >= 0.9


def test_ties_invalid_rows_repeats_and_few_candidates(spark):
    bad = [(40, None, "x"), (41, [0.0, 0.0], "x"), (42, [1.0, None], "x"), (43, [float("nan"), 1.0], "x"), (44, [float("inf"), 1.0], "x"), (None, [1.0, 1.0], "x"), (45, [], "x"), (46, [1.0, 2.0, 3.0], "x")]
    rows = [(20, [1.0, 0.5], "x"), (5, [2.0, 1.0], "x"), (3, [2.0, 1.0], "x"), (3, [2.0, 1.0], "x"), (0, [1.0, 0.5], "x"), *bad]
    assert run(spark, rows) == {0: [(3, 2.5), (5, 2.5), (20, 1.25)], 20: [(3, 2.5), (5, 2.5), (0, 1.25)]}
    assert run(spark, rows, k=1) == {0: [(3, 2.5)], 20: [(3, 2.5)]}
    assert run(spark, []) == {}


def test_index_holds_every_vector_once(spark):
    df = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id") + 1.0, F.lit(2.0), F.lit(-1.0)).alias("embedding"))
    rows = vectors.one_bit_index(df).collect()
    assert len(rows) == 100 and all(len(r["code"]) == 1 and 0 < r["fix"] <= 1 + 1e-12 for r in rows)


def test_packed_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(4)
    for dim in (5, 64, 100, 384):
        x = rng.standard_normal((500, dim)) * rng.uniform(0.1, 3, (500, 1))
        turn = vectors.rotation(dim)
        packed, norm, fix = vectors._code(x, turn)
        signs = (np.unpackbits(packed, axis=1, count=dim) * 2.0 - 1) / np.sqrt(dim)
        codes = vectors.words_of(packed)
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        misses = 0
        for q in rng.standard_normal((20, dim)):
            unit = turn @ q / np.linalg.norm(q)
            code = vectors.QueryCode(unit)
            counted = code.products(codes, ones)
            # Counting bits is the inner product with the rounded query.
            assert np.abs(counted - signs @ unit).max() <= code.rounding + 1e-12
            true = x @ q / np.linalg.norm(q)
            spread = vectors.BOUND * norm / fix * np.sqrt(1 - fix**2) / np.sqrt(dim - 1) + code.rounding * norm / fix
            misses += (np.abs(counted * norm / fix - true) > spread).sum()
        assert misses <= 0.01 * 20 * 500


def test_queries_meet_vectors_of_their_own_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(3 + 5 * (i % 3))], "x") for i in range(200)]
    found = run(spark, rows, k=5, vector_block=30, query_block=3)
    for dim in (3, 8, 13):
        same = [r[:2] for r in rows if len(r[1]) == dim]
        for q, best in brute(same, 5).items():
            assert {i for i, _ in found[q]} <= {i for i, _ in same} and len(found[q]) == 5
            assert len(dict(found[q]).keys() & dict(best).keys()) >= 4
    assert found.keys() == {i for i, *_ in rows if i % 20 == 0}


def test_recall_on_the_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = brute(rows, 20)
    found = {}
    for r in QUERIES["op1_one_bit_search"](spark, sf_dir).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(found[q] & {i for i, _ in best}) for q, best in expected.items())
    assert hits >= 0.98 * sum(map(len, expected.values()))
