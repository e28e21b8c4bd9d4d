"""The stages against plain versions on a small corpus, and all registered queries."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from packsift.llm import decontaminate, toxicity
from packsift.llm.queries import ORACLE, QUERIES
from tests.compare import connect, rows_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(spark, prose, tmp_path_factory):
    """A folder of tables: clean, toxic, copied and contaminated documents, one shared line."""
    folder, rng = str(tmp_path_factory.mktemp("tables")), random.Random(3)
    slurs = ["vorbul", "skazzle", "gritmo", "plonkard"]
    items = [(i, prose(f"item{i}", 20)) for i in range(5)]
    rows, labels, kinds = [], [], {}
    for i in range(300):
        words = prose(f"d{i}", 60 + i % 50).split()
        kind = "toxic" if i % 5 == 0 else "clean"
        if kind == "toxic":
            for _ in range(7):
                words.insert(rng.randrange(len(words)), rng.choice(slurs))
        kinds[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
        rows.append((i, " ".join(words) + "\nall rights kept here", "en", f"s{i % 12}"))
    for i in range(1, 61, 3):  # copies of clean documents, exact and near
        if kinds[i] == "clean":
            text = rows[i][1]
            rows += [(1000 + i, text, "en", "s1"), (2000 + i, text.replace(text.split()[9], "edited", 1), "en", "s2")]
            kinds[1000 + i] = kinds[2000 + i] = "copy"
    for i, (_, text) in enumerate(items):
        rows.append((3000 + i, f"{prose(f'x{i}', 70)} {text} {prose(f'y{i}', 30)}", "en", "s3"))
        kinds[3000 + i] = "contaminated"
    rows += [(4000, None, None, None), (4001, "", None, None), (4002, "lone", "en", "s4")]
    kinds |= {4000: "clean", 4001: "clean", 4002: "clean"}
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kinds


def test_each_stage_does_its_work_and_keeps_the_rest(spark, small, tmp_path):
    folder, kinds = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    of = lambda kind: {i for i, k in kinds.items() if k == kind}
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if number < 4:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    toxicity_, shared, near, clean, coded = seen.values()
    assert len(of("toxic") & toxicity_.keys()) <= 0.05 * len(of("toxic"))
    assert len((kinds.keys() - of("toxic")) - toxicity_.keys()) <= 0.01 * len(kinds)
    assert shared.keys() == toxicity_.keys()
    for i, r in shared.items():
        before = toxicity_[i]["text"]
        assert r["text"] == (before and "\n".join(line for line in before.split("\n") if line != "all rights kept here"))
        assert r["n_chars"] == (None if before is None else len(r["text"]))
    assert near.keys() == shared.keys() - {i for i in of("copy") if i % 1000 in shared}
    assert clean.keys() == near.keys() - of("contaminated")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert coded.keys() == clean.keys()
    for i, r in coded.items():
        ids = tokenizer.encode(clean[i]["text"] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == coded.keys()


def test_stages_take_empty_tables_and_columns_of_their_own_names(spark, small):
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.where("doc_id >= 3000").selectExpr("*", "'x' AS toxicity", "1 AS r1", "2 AS gone", "3 AS n_lines", "4 AS id", "5 AS row")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), folder).count() == 0
        assert stage(spark, wide, folder).select("toxicity", "r1", "gone", "n_lines", "id", "row").distinct().count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), folder).count() == 0


def test_every_operator_is_registered():
    names = list(QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    found = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding",
    ]
    assert toxicity.THRESHOLD == 0.7 and decontaminate.RECALL >= 0.9


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_against_sql(spark, sf_dir, name):
    db = connect(sf_dir)
    frame = QUERIES[name](spark, sf_dir)
    ours = rows_of(frame.columns, frame.collect())
    result = db.execute(ORACLE[name])
    assert ours == rows_of([c[0] for c in result.description], result.fetchall())
