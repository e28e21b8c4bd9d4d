import public_tokenizers
import pytest
from tokenizers import Tokenizer

from packsift.llm import chunked_bpe, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n", "a", "It's  the dog's\tbone,\r\n isn't it?  ", "  lead", "trail  ", "x \n y", "nbsp here  wide",
    "<|endoftext|>", "a <|endoftext|>b<|endoftext|> é", "<|startoftext|> x", "é ́x İstanbul ΣΣ", "日本語のテキスト", "emoji 🙂🙂🏽",
    "1234 5,6.7 x.y ..., ,.", "z" * 3000, "q" * 700 + " " + "w" * 1200, "\x1c\x85 odd\x0bspaces", "A'S 'll d've", "end.", "café, naïve. ², ª.",
]


def library(path, text):
    tokenizer = Tokenizer.from_file(path)
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def texts(prose):
    passage = prose("p", 900)
    shared = [f"{prose(i, 50)} {passage}{'' if i % 2 else ' '}{prose(-i, 60)}, end." for i in range(6)]
    glued = [prose(i, 40).replace(" ", "") + passage.replace(" ", "") for i in range(3)]  # no white space at all
    return [*TEXTS, *shared, shared[0], *glued]


def test_ids_and_decoded_text_agree_with_the_library(spark, make_docs, texts):
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)], extra=("id", "seq", "chunk", "ids", "key"))
    for cut_bits in (4, chunked_bpe.CUT_BITS):
        rows = chunked_bpe.encode_documents(docs, WORD, cut_bits=cut_bits).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            if r["doc_id"] is not None:
                assert (r["ids"], r["decoded"]) == library(WORD, texts[r["doc_id"]]), texts[r["doc_id"]]
    assert chunked_bpe.encode_documents(make_docs([]), WORD).count() == 0


def test_chunks_follow_content(prose):
    import numpy as np

    def cut(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return list(chunked_bpe._chunks_of(raw, np.array([0, len(raw)]), 6))[0]

    body = prose("c", 2000)
    one, two = cut("short lead " + body), cut(prose("d", 77) + body + " tail")
    assert b"".join(one).decode() == "short lead " + body
    assert len(set(one) & set(two)) > 0.9 * len(one) - 4


def test_joints_widen_until_they_agree_and_fall_back_to_the_whole_text():
    coder = chunked_bpe.WordCoder(WORD)
    texts = [b"zero one tw", b"o three four five six", b" seven"]
    plain = coder.library([b"".join(texts).decode()])[0]

    def parts(wrong=()):
        out = []
        for text in texts:
            lo, hi = chunked_bpe._bounds(text)
            ids = coder.encode(text[lo:hi])
            for word in wrong:
                ids = ids.replace(coder.encode(word), coder.encode(b"wrong"))
            out.append((text, ids))
        return out

    asked = []
    library = coder.library
    coder.library = lambda found: asked.append(found) or library(found)
    assert chunked_bpe.joined(coder, [parts(), [(t, None) for t in texts], []]) == [plain, plain, b""]
    # A library that reads two words as one token at the joint only: the guard of one word does
    # not come out as in its chunk, that of two does.
    three = coder.encode(b"three")

    def merging(found):
        return [library([x])[0].replace(three, b"\x05\x00") if x.endswith("three") and " " in x else library([x])[0] for x in found]

    asked.clear()
    coder.library = lambda found: asked.append(found) or merging(found)
    assert chunked_bpe.joined(coder, [parts()]) == [plain]
    assert any("three four" in x for found in asked[1:] for x in found) and not any("zero one two three four five six seven" in x for found in asked for x in found)
    # Ids of a chunk that no number of words agrees with.
    coder.library = lambda found: asked.append(found) or library(found)
    asked.clear()
    assert chunked_bpe.joined(coder, [parts(wrong=(b"one", b"three", b"four", b"five"))]) == [plain]
    assert asked[-1] == ["zero one two three four five six seven"]


def test_tokens_that_hold_white_space_are_refused(tmp_path):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.add_tokens(["one two"])
    tokenizer.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        chunked_bpe.check_tokenizer(str(tmp_path / "t.json"))
    chunked_bpe.check_tokenizer(WORD)


def test_a_tokenizer_with_spaces_in_tokens_is_refused():
    with pytest.raises(ValueError):
        chunked_bpe.check_tokenizer(BYTE)


def test_counts_agree_with_the_library(spark, make_docs, texts):
    docs = make_docs([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (0, "again")], extra=("row", "piece", "n"))
    rows = token_counts.count_tokens(docs, BYTE).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"]:
            text = texts[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library(BYTE, text)[0])), text
    assert token_counts.count_tokens(make_docs([]), BYTE).count() == 0


def test_rare_pieces_go_through_the_join(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD_PIECES", 3)
    text = prose(3, 400)
    row = token_counts.count_tokens(make_docs([(1, text), (2, text + " x")]), BYTE).orderBy("doc_id").first()
    assert row["n_tokens"] == len(library(BYTE, text)[0])


def test_words_are_kept_over_tasks_and_generations(monkeypatch):
    monkeypatch.setattr(chunked_bpe, "KEPT_WORDS", 40)
    coder = chunked_bpe.WordCoder(WORD)
    asked = []
    library = coder.library
    coder.library = lambda texts: asked.extend(texts) or library(texts)
    often = b"kept word"
    for i in range(30):
        text = often + b" " + b" ".join(b"w%dx" % (10 * i + j) for j in range(10))
        assert coder.encode(text) == library([text.decode()])[0]
        assert len(coder.ids) + len(coder.older) <= 2 * 40
    assert sum("kept" in text for text in asked) == 1
    assert chunked_bpe.word_coder(WORD) is chunked_bpe.word_coder(WORD)


def test_marks_at_the_end_are_cut_where_the_library_cuts():
    coder = chunked_bpe.WordCoder(WORD)
    assert {",", ".", "!", "$", "*", "'"} <= set(coder.marks) and not set("<|>") & set(coder.marks)
    words = ["ab!!", "ab$$$", "dog's", "dogs'", "a'S!'", "x-1,.", "<|endoftext|>", "a<|endoftext|>!", "é***", "日本!!", "≠", "a≠", "1%", "(785)", "´´.", "İ!", "ΣΣ.", "...", "á!"]
    for word in words:
        assert coder.encode(word.encode()) == coder.library([word])[0], word
    assert coder.encode(" ".join(words).encode()) == coder.library([" ".join(words)])[0]


def test_long_text_between_chunks_is_encoded_by_words():
    coder = chunked_bpe.WordCoder(WORD)
    middle = b" fresh" + b" middle words." * 60 + b" end"
    texts = [b"zero one tw", b"o three four fi", middle, b"x seven eight n", b"ine"]
    parts = [(t, coder.encode(t[slice(*chunked_bpe._bounds(t))]) if i in (0, 1, 3) else None) for i, t in enumerate(texts)]
    plain = coder.library([b"".join(texts).decode()])[0]
    asked = []
    library = coder.library
    coder.library = lambda found: asked.extend(found) or library(found)
    assert chunked_bpe.joined(coder, [parts]) == [plain]
    assert max(map(len, asked)) < 100


def test_long_pieces_are_not_counted_and_few_are_held(prose):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [f"{'z' * 5000}{i} short one one" for i in range(50)]})
    found = pa.Table.from_batches(list(token_counts._frequent(iter([batch]))))
    assert dict(zip(*found.to_pydict().values(), strict=True)) == {" short": 50, " one": 100}
