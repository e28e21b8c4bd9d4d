"""BPE encoding and decoding that encodes content shared between documents once.

Texts are cut into chunks where a rolling hash of the last 32 bytes has its low bits
zero, so equal content is cut alike wherever it stands. Chunk hashes are counted over
all documents; each chunk that occurs more than once is encoded once. A document is
put together from its chunks: where two meet, the text around the joint is encoded
again by the library, together with one word on either side that must come out as before. Where it
does not, more words are taken, at last the whole text.

The tokenizer must drop white space in its pre-tokenizer, so a text that is cut at
ASCII white space is encoded like its parts. Words are then encoded by the library
once each, as long as a worker process keeps them.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packsift.llm.keyfilter import DEFAULT_LOG2_BITS, key_filter
from packsift.llm.library import loaded
from packsift.llm.tables import pick, settle
from packsift.llm.textbytes import slices, splitmix, text_buffer

#: One position in 2^CUT_BITS is a cut.
CUT_BITS = 9
#: Words that a worker process keeps encoded, twice: when there are more, those not met since the
#: last time go.
KEPT_WORDS = 150_000
#: Words of letters that are encoded in one call.
TOGETHER = 512
#: Documents put together at a time.
READ_ROWS = 256
#: Chunks encoded at a time.
ENCODE_ROWS = 1024
#: Text between two encoded chunks is encoded word by word if it has more bytes.
LONG_MIDDLE = 256
_WINDOW = 32
_SPACES = b" \t\n\x0b\x0c\r"
_EACH_SPACE = [bytes([c]) for c in _SPACES]
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")
#: Letters of the first blocks.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class WordCoder:
    """Ids of words, each encoded once by the library and kept as bytes.

    Words of letters only are encoded many in one call, with a space between them: each is then
    one piece of the pre-tokenizer, and the mark at its last token tells where it ends.
    """

    def __init__(self, path: str):
        self.tokenizer = loaded(path)
        self.names = token_names(self.tokenizer)
        self.name_array = pa.array(self.names, pa.string())
        self.last = np.array([n.endswith("</w>") for n in self.names])
        # Ids are kept and moved in as few bytes as the vocabulary allows.
        self.kind = np.dtype(np.uint16 if len(self.names) <= 1 << 16 else np.int32)
        self.marks = separate_marks(self.tokenizer)
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed."""
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            raw = self.library([" ".join(part)])[0]
            ends = (np.flatnonzero(self.last[np.frombuffer(raw, self.kind)]) + 1) * self.kind.itemsize
            if len(ends) == len(part) and ends[-1] == len(raw):
                marks = [0, *ends.tolist()]
                out += [raw[lo:hi] for lo, hi in zip(marks[:-1], marks[1:], strict=True)]
            else:
                out += self.library(part)
        return out

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        fresh = [w for w in words if w not in self.ids]
        if len(self.ids) + len(fresh) > KEPT_WORDS and self.ids:
            self.older, self.ids = self.ids, {}
            fresh = words
        if self.older:
            self.ids.update([(w, self.older[w]) for w in fresh if w in self.older])
            fresh = [w for w in fresh if w not in self.older]
        if fresh:
            split = [self._last_marks(w) for w in fresh]
            parts = list({part for two in split for part in two})
            plain = [p for p in parts if _LETTERS.fullmatch(p)]
            known = dict(zip(plain, self._together(plain), strict=True))
            other = [p for p in parts if p not in known]
            known.update(zip(other, self.library(other), strict=True))
            self.ids.update([(w, known[two[0]] if len(two) == 1 else known[two[0]] + known[two[1]]) for w, two in zip(fresh, split, strict=True)])
        return list(map(self.ids.__getitem__, words))

    def _last_marks(self, word: str) -> tuple[str, ...]:
        """A word without the marks at its end, and these: after a letter or digit (of the first
        blocks, if it is one in lower case too) the pre-tokenizer cuts between them."""
        stem = word.rstrip(self.marks)
        if len(stem) < len(word) and stem and stem[-1] < "\u0250" and stem[-1].lower().isalnum():
            return stem, word[len(stem) :]
        return (word,)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, packed."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        known = pa.array(self.learn(words.dictionary.to_pylist()), pa.large_binary())
        if "" in self.ids:  # before and behind white space at the ends of a text
            del self.ids[""]
        _, ends, data = known.take(words.indices).buffers()
        if not data or not len(words):
            return [b""] * len(texts)
        marks = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(data)
        return [bytes(raw[lo:hi]) for lo, hi in zip(marks[:-1], marks[1:], strict=True)]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


def word_coder(path: str) -> WordCoder:
    """The worker process's coder of a tokenizer, with the words that earlier tasks learned."""
    found = os.stat(path)
    return _word_coder(path, found.st_mtime_ns, found.st_size)


@lru_cache(maxsize=1)
def _word_coder(path: str, *_version: int) -> WordCoder:
    return WordCoder(path)


def separate_marks(tokenizer) -> str:
    """ASCII marks that are cut from a letter or digit before them, however many follow. Those that
    an added token holds are none."""
    added = {c for token in tokenizer.get_added_tokens_decoder().values() for c in token.content}
    coded = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    same = lambda mark: all(coded(f"{a}{mark}{b}") == coded(f"{a} {mark}{b}") for a in ("ab", "1", "\u00e9") for b in ("", mark, mark + "."))
    return "".join(m for m in string.punctuation if m not in added and same(m))


def token_names(tokenizer) -> list[str]:
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    names = [""] * (max(vocabulary.values()) + 1)
    for name, i in vocabulary.items():
        names[i] = name
    return names


def check_tokenizer(path: str) -> None:
    """Refuse a tokenizer for which white space is part of a token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain, spread = (tokenizer.encode(t, add_special_tokens=False) for t in ("ab cd", "\n ab \t\x0b\x0c\r cd  "))
    spaced = any(c.isspace() for name in token_names(tokenizer) for c in name)
    if plain.ids != spread.ids or tokenizer.decoder is not None or spaced:
        raise ValueError("the tokenizer must drop white space, have no token that holds any, and no decoder of its own")


def cut_points(data: np.ndarray, offsets: np.ndarray, cut_bits: int = CUT_BITS) -> np.ndarray:
    """Ends of chunks in a slice of documents: every end of a document that is not empty, and each
    place after a byte whose rolling hash is zero in ``cut_bits`` bits. A place within
    a character moves to its end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    table = splitmix(np.arange(256, dtype=np.uint64)).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = table[data]
        step = 1
        while step < _WINDOW:  # gear hash of the last 2 * step bytes
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
    cut = np.flatnonzero((h >> np.uint32(32 - cut_bits)) == 0) + 1
    # The hash must not reach into the document before.
    heads = offsets[np.searchsorted(offsets, cut, "left") - 1]
    cut = cut[cut - heads >= _WINDOW]
    for _ in range(3):
        inner = (cut < n) & ((data[np.minimum(cut, n - 1)] & 0xC0) == 0x80)
        cut = cut + inner
    return np.unique(np.concatenate([cut, offsets[1:][np.diff(offsets) > 0]]))


def _chunks_of(data: np.ndarray, offsets: np.ndarray, cut_bits: int) -> Iterator[list[bytes]]:
    """Chunks of each document of a slice."""
    ends = cut_points(data, offsets, cut_bits)
    raw = data.tobytes()
    at = np.searchsorted(ends, offsets, "right")
    for d in range(len(offsets) - 1):
        out, lo = [], int(offsets[d])
        for end in ends[at[d] : at[d + 1]].tolist():
            out.append(raw[lo:end])
            lo = end
        yield out


def _key(chunk: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(chunk)


def _second_key(chunk: bytes) -> int:
    """With the first key, 128 bits that stand for a chunk."""
    import xxhash

    return xxhash.xxh64_intdigest(chunk) - (1 << 63)


def _emit_keys(cut_bits: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(0))
            for a, b in slices(offs):
                part = offs[a : b + 1] - offs[a]
                keys = [_key(c) for doc in _chunks_of(data[offs[a] : offs[b]], part, cut_bits) for c in doc]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], names=["key"])

    return emit


def _read_chunks(batches: Iterator[pa.RecordBatch], column: int, cut_bits: int, shared):
    """For each slice of each batch: the batch, the first document, and of every document
    its chunks, their keys, and which of them may be shared."""
    for batch in batches:
        data, offs = text_buffer(batch.column(column))
        for a, b in slices(offs):
            docs = list(_chunks_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], cut_bits))
            flat = np.array([_key(c) for doc in docs for c in doc], np.uint64)
            passed, out, at = shared.passes(flat).tolist(), [], 0
            keys = flat.view(np.int64).tolist()
            for doc in docs:
                out.append((doc, keys[at : at + len(doc)], passed[at : at + len(doc)]))
                at += len(doc)
            yield batch, a, out


def _readable(coder: WordCoder, ids: pa.Array, coded: list[bytes]) -> pa.RecordBatch:
    """Ids as lists of integers, and the decoded texts: the names of the tokens with a
    space between them, which is what a tokenizer without a decoder gives."""
    flat = np.frombuffer(b"".join(coded), coder.kind).astype(np.int32)
    ends = np.cumsum([0, *[len(x) // coder.kind.itemsize for x in coded]]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    named = pa.ListArray.from_arrays(lists.offsets, coder.name_array.take(lists.values))
    return pa.RecordBatch.from_arrays([ids, lists, pc.binary_join(named, " ")], names=["id", "ids", "decoded"])


def _encode_unshared(path: str, cut_bits: int, shared):
    """Ids of the documents that hold no shared chunk; the others are left out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for batch, first, docs in _read_chunks(batches, 1, cut_bits, shared):
            own = [(first + d, b"".join(chunks)) for d, (chunks, _, passed) in enumerate(docs) if not any(passed)]
            yield _readable(coder, batch.column(0).take(pa.array([r for r, _ in own], pa.int64())), coder.encode_all([text for _, text in own]))

    return encode


def _split_sharing(cut_bits: int, shared):
    """A row per chunk of the documents that hold a shared one; neighbouring chunks that are
    not shared are one row without a key."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, docs in _read_chunks(batches, 2, cut_bits, shared):
            rows, seqs, keys, seconds, parts = [], [], [], [], []
            for d, (chunks, own_keys, passed) in enumerate(docs):
                if not any(passed):
                    continue
                seq, run = 0, []
                for chunk, is_shared, key in zip([*chunks, b""], [*passed, True], [*own_keys, None], strict=True):
                    if not is_shared:
                        run.append(chunk)
                        continue
                    for one, one_key in ((b"".join(run), None), (chunk, key)):
                        if one:
                            rows.append(first + d), seqs.append(seq), keys.append(one_key), parts.append(one)
                            seconds.append(None if one_key is None else _second_key(one))
                            seq += 1
                    run = []
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(seqs, pa.int32()), pa.array(keys, pa.int64()), pa.array(seconds, pa.int64()), pa.array(parts, pa.binary())],
                names=["row", "id", "seq", "key", "key2", "chunk"],
            )

    return split


def _bounds(chunk: bytes) -> tuple[int, int]:
    """Where the first word of a chunk may still begin before it, and where its last
    word may go on behind it: the inner part lies between two separators."""
    first = next((i for i, c in enumerate(chunk) if c in _SPACES), None)
    if first is None:
        return len(chunk), len(chunk)
    last = max(chunk.rfind(s) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return first, last + 1


def _encode_chunks(path: str):
    """``(key, key2, chunk)`` -> with the ids of the inner part of a chunk."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ENCODE_ROWS):
                batch = whole.slice(at, ENCODE_ROWS)
                inner = [chunk[slice(*_bounds(chunk))] for chunk in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coder.encode_all(inner), pa.binary())], names=["key", "key2", "chunk", "ids"])

    return encode


def _ends_of_words(text: bytes, count: int) -> tuple[int, int]:
    """Where the last ``count`` words of a text begin, and where the first ``count`` end; the
    whole text if it has no more."""
    if count == 1:
        last = text.rstrip(_SPACES)
        first = _WORD.search(text)
        return 1 + max(last.rfind(c) for c in _EACH_SPACE), first.end() if first else len(text)
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) <= count:
        return 0, len(text)
    return spans[-count][0], spans[count - 1][1]


class _Joint:
    """Where two encoded chunks meet: text on the left, text not yet encoded, text on the
    right, with the ids of both sides."""

    def __init__(self, left: tuple[bytes, bytes], middle: bytes, right: tuple[bytes, bytes]):
        self.left, self.middle, self.right = left, middle, right

    def strings(self, words: int) -> tuple[bytes, bytes, bytes]:
        """Guards of so many words, and the text from guard to guard."""
        head = self.left[0][_ends_of_words(self.left[0], words)[0] :]
        tail = self.right[0][: _ends_of_words(self.right[0], words)[1]]
        return head, tail, head + self.middle + tail

    def between(self, head: bytes, tail: bytes, whole: bytes) -> bytes | None:
        """Ids of the middle, if the guards come out as they did in their chunks."""
        fits = self.left[1].endswith(head) and self.right[1].startswith(tail) and len(whole) >= len(head) + len(tail)
        return whole[len(head) : len(whole) - len(tail)] if fits and whole.startswith(head) and whole.endswith(tail) else None

    def spent(self, words: int) -> bool:
        return max(len(self.left[0].split()), len(self.right[0].split())) <= words


def _joints(parts: list[tuple[bytes, bytes | None]]) -> list[_Joint | tuple[bytes, bytes] | bytes]:
    """A text as joints between the encoded inner parts, inner parts and open text at both
    ends."""
    out, open_end, last = [], b"", None
    for text, inner_ids in parts:
        if not inner_ids:
            open_end += text
            continue
        lo, hi = _bounds(text)
        here = (text[lo:hi], inner_ids)
        out.append(_Joint(last, open_end + text[:lo], here) if last else open_end + text[:lo])
        out.append(here)
        last, open_end = here, text[hi:]
    return [*out, open_end]


def _with_middles(coder: WordCoder, documents: list[list[tuple[bytes, bytes | None]]]) -> list[list[tuple[bytes, bytes | None]]]:
    """The documents with the ids of long texts that stand between encoded ones."""
    out, places = [list(parts) for parts in documents], []
    for d, parts in enumerate(out):
        done = [i for i, (_, ids) in enumerate(parts) if ids]
        places += [(d, i) for i in range(done[0] + 1, done[-1]) if parts[i][1] is None and len(parts[i][0]) > LONG_MIDDLE] if done else []
    ids = coder.encode_all([out[d][i][0][slice(*_bounds(out[d][i][0]))] for d, i in places])
    for (d, i), found in zip(places, ids, strict=True):
        out[d][i] = (out[d][i][0], found)
    return out


def joined(coder: WordCoder, documents: list[list[tuple[bytes, bytes | None]]]) -> list[bytes]:
    """Ids of each document from its chunks ``(text, ids)`` in their order; ids are those of the
    inner part, or None for text that was not encoded yet.

    At each joint the library encodes the open text together with a word on either side as one
    string. The words must come out as they did in their chunks; where they do not, twice as
    many are taken, and when a side has no more the whole text is encoded. Long text between two
    chunks is encoded like a chunk first, text at the ends of a document word by word.
    """
    documents = _with_middles(coder, documents)
    cut = [_joints(parts) for parts in documents]
    ends = list(dict.fromkeys(piece for pieces in cut for piece in pieces if isinstance(piece, bytes)))
    open_ids = dict(zip(ends, coder.encode_all(ends), strict=True))
    asked = {x: joint.strings(1) for pieces in cut for x, joint in ((id(j), j) for j in pieces if isinstance(j, _Joint))}
    texts = list(dict.fromkeys(s for three in asked.values() for s in three))
    ids = dict(zip(texts, coder.library([t.decode() for t in texts]), strict=True))
    out = []
    for pieces, parts in zip(cut, documents, strict=True):
        coded: list[bytes] | None = []
        for piece in pieces:
            if isinstance(piece, tuple):
                coded.append(piece[1])
            elif isinstance(piece, bytes):
                coded.append(open_ids[piece])
            else:
                found, words = piece.between(*(ids[s] for s in asked[id(piece)])), 1
                while found is None and not piece.spent(words):
                    words *= 2
                    found = piece.between(*coder.library([s.decode() for s in piece.strings(words)]))
                if found is None:
                    coded = None
                    break
                coded.append(found)
        out.append(coder.library([b"".join(p[0] for p in parts).decode()])[0] if coded is None else b"".join(coded))
    return out


def _assemble(path: str):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(at, READ_ROWS)
                coded = joined(coder, [[(p["chunk"], p["ids"]) for p in parts] for parts in part.column(1).to_pylist()])
                yield _readable(coder, part.column(0), coded)

    return assemble


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    cut_bits: int = CUT_BITS,
    log2_filter_bits: int = DEFAULT_LOG2_BITS,
) -> DataFrame:
    """``(id_column, ids array<int>, decoded)`` for every row of ``docs``: the ids the
    library gives for the whole text without added special tokens, and what its
    ``decode`` makes of them with special tokens kept.

    A null or empty text, or one of white space, has no ids and decodes to the empty
    text. Null and repeated ids are rows like others; an empty table gives no rows.
    """
    check_tokenizer(tokenizer_path)
    rows = pick(docs, id=id_column, text=text_column)
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.select("text").mapInArrow(_emit_keys(cut_bits), "key long").groupBy("key").count()
    shared = key_filter(counted.where(F.col("count") > 1), "key", log2_filter_bits)
    fields = f"id {kind}, ids array<int>, decoded string"
    done = rows.mapInArrow(_encode_unshared(tokenizer_path, cut_bits, shared), fields)
    # The row number only lives in the written table, where it is fixed.
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    rest = settle(numbered.mapInArrow(_split_sharing(cut_bits, shared), f"row long, id {kind}, seq int, key long, key2 long, chunk binary"), "chunks", compression="zstd")
    # Occurrences of a chunk are keys only; its text comes along with its ids.
    distinct = rest.where(F.col("key").isNotNull()).select("key", "key2", "chunk").dropDuplicates(["key", "key2"])
    encoded = distinct.mapInArrow(_encode_chunks(tokenizer_path), "key long, key2 long, chunk binary, ids binary")
    placed = rest.where(F.col("key").isNotNull()).select("row", "id", "seq", "key", "key2").join(encoded, ["key", "key2"])
    parts = placed.select("row", "id", F.struct("seq", "chunk", "ids").alias("part"))
    bare = rest.where(F.col("key").isNull()).select("row", "id", F.struct("seq", "chunk", F.lit(None).cast("binary").alias("ids")).alias("part"))
    whole = parts.unionByName(bare).groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list("part")).alias("parts"))
    return done.unionByName(whole.select("id", "parts").mapInArrow(_assemble(tokenizer_path), fields)).withColumnRenamed("id", id_column)
