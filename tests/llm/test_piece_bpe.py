import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from packsift.llm import piece_bpe
from packsift.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "   x  y ", "\n\n", "hello world", "a▁b", "foo▁ bar ▁ baz", "▁", "日本語のテキスト", "🙂🏽x", "\x00a\x00", "<s>", "</s> <unk> <0x41>",
    "é", "é", " " * 300, "a" * 3000, "ab" * 500, "\t\t\tx", "x" + " " * 37 + "y", "=" * 70, "-" * 300, "𝔘𝔫𝔦", "﻿x", "ﷺ", "\r\n\r\n    def f(x):\n        return x+1\n",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.PieceCoder(MODEL)


def own(coder, texts):
    return [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(texts)]


def test_ids_and_decoded_text_agree_with_the_library(spark, make_docs, library, prose):
    texts = [*TEXTS, prose(1, 4000), prose(2, 700).replace(" ", ""), prose(1, 4000)]
    rows = [*enumerate(texts), (None, "no id"), (None, None)]
    docs = make_docs(rows, extra=("ids", "decoded", "id"))
    for found in (piece_bpe.encode_documents(docs, MODEL).collect(), piece_bpe.encode_documents(docs, MODEL, packed=True).collect()):
        assert len(found) == len(rows)
        for r in found:
            ids = r["ids"] if isinstance(r["ids"], list) else np.frombuffer(r["ids"], "<u4").tolist()
            candidates = [texts[r["doc_id"]]] if r["doc_id"] is not None else ["no id", None]
            plain = [library.encode(t or "", add_bos=True, add_eos=True) for t in candidates]
            assert (ids, r["decoded"]) in [(p, library.decode(p)) for p in plain]
    bare = piece_bpe.encode_documents(docs, MODEL, begin=False, end=False).where("doc_id = 6").first()
    assert bare["ids"] == library.encode("hello world")
    assert piece_bpe.encode_documents(make_docs([]), MODEL).count() == 0


def test_random_texts(coder, library):
    rng = random.Random(1)
    letters = [*"abcdefghinorst ▁\n.,'0123=-*", "é", "日", "本", "🙂", "th", "ing", " the"]
    pieces = [library.id_to_piece(i) for i in range(3, library.get_piece_size())]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(800)]
    texts += ["".join(rng.choice("aab ") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    assert own(coder, texts) == [library.encode(t) for t in texts]


def test_long_words_end_soon(coder, library):
    rng = random.Random(3)
    pieces = [library.id_to_piece(i) for i in range(300, 32000)]
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), " " * 100_000, "a" * 300_000, "".join(rng.choice(pieces) for _ in range(50_000))]
    assert own(coder, texts) == [library.encode(t) for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_rounds_are_as_merging_one_by_one(seed):
    """Also for pieces whose order no training would give."""
    rng = random.Random(seed)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(25)} | {"a", "b"})
    model = piece_bpe.PieceModel.__new__(piece_bpe.PieceModel)
    model.size = len(pieces)
    model.fill({p: i for i, p in enumerate(pieces)}, np.array([-float(rng.randrange(12)) for _ in pieces]))
    words = ["".join(rng.choice("abcd"[: rng.randrange(2, 5)]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    first = np.cumsum([0, *map(len, words)])[:-1]
    out = piece_bpe.merge_rounds(model, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), first)
    for word, at in zip(words, first.tolist(), strict=True):
        expected = dict(piece_bpe.merge_by_merge(model, [int(model.symbols[ord(c)]) for c in word]))
        assert out[at : at + len(word)].tolist() == [expected.get(i, -1) for i in range(len(word))]


def test_words_that_are_not_kept_any_more_are_encoded_anew(coder, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(piece_bpe, "TOGETHER", 8)
    for n in range(6):
        texts = [f"some {n} words and {n + 1} more, of which {'few' * 30} stay", "some words"]
        assert own(coder, texts) == [library.encode(t) for t in texts]
        assert all(len(w) <= piece_bpe.KEPT_CHARACTERS for w in coder.kept)


def test_other_kinds_of_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1]))  # a trainer's message with another kind of model
    with pytest.raises(ValueError):
        piece_bpe.PieceModel(str(path))


def test_query_agrees_with_the_library_on_all_documents(spark, sf_dir, library):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = {}
    for row in table:
        ids = library.encode(row["text"] or "", add_bos=True, add_eos=True)
        hashed = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        expected[row["doc_id"]] = (len(ids), *hashed)
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_piece_bpe"](spark, sf_dir).collect()} == expected
