import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colprobe.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [
    " ", "  ", "\n", "a", "é", "1", "'", "'s", "’", " ", "　", "\x1c", "\x85", "\t", "漢",
    "🙂", "‍", "́", "²", "Ⅷ", "\x00", "ſ", "İ", "_", "-", "<|endoftext|>", "the", "aaa", "ing",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def some_texts(n=3000):
    rng = random.Random(7)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 14))) for _ in range(n)]
    texts += ["".join(rng.choices("abcdefgh", k=900)), "a" * 1001, "ab" * 700, " " * 5000, "\n" * 999 + "x"]
    return texts


def test_encoder_agrees_with_the_library(library, tmp_path):
    texts = some_texts()
    words = sorted({w.encode() for t in texts[::2] for w in bpe.WORD.findall(t)})[::2]
    vocabulary = bpe.vocabulary(PATH)
    ids = vocabulary.merge(words)
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(zip(words, ids, strict=True)))
    lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
    assert lexicon.find(words) == ids
    assert lexicon.find([b"", b"not in it"]) == [None, None]
    for encoder in (bpe.Encoder(vocabulary), bpe.Encoder(vocabulary, lexicon)):
        found = encoder.encode(texts)
        assert found == [library(t) for t in texts]
        assert [vocabulary.decode(f) for f in found] == texts


def test_lexicon_is_minimal_and_may_be_empty(tmp_path):
    entries = [(w, n.to_bytes(4, "little")) for n, w in enumerate([b"singing", b"taking", b"walking"])]
    (tmp_path / "one").write_bytes(bpe.compile_lexicon(entries))
    lexicon = bpe.Lexicon(str(tmp_path / "one"))
    assert len(lexicon.finals) == 12  # the endings "king" and "ing" are shared
    assert lexicon.find([w for w, _ in entries]) == [i for _, i in entries]
    (tmp_path / "none").write_bytes(bpe.compile_lexicon([]))
    assert bpe.Lexicon(str(tmp_path / "none")).find([b"a"]) == [None]


def test_frequent_words(make_docs):
    docs = make_docs([(1, "b b b b a a c"), (2, "b d")])
    assert bpe.frequent_words(docs, 10) == [" b", " a", "b"]
    assert bpe.frequent_words(docs, 1) == [" b"]


def test_encode_rows(odd_docs, no_docs, library):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"]}
    rows = bpe.encode_decode(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"]:
            ids = library(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids) // 4
            assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_decode(no_docs, PATH).count() == 0


def test_fast_tokens_agree_and_fall_back(library):
    tokens = packing.Tokens(PATH)
    assert tokens.fast is not None
    for text in [*some_texts(500), " " * 300_000 + "x"]:
        assert tokens.ids(text).astype("<u4").tobytes() == library(text)


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    room, expected = [], []
    for length in lengths:
        fits = [r for r in room if r >= length]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - length)
        else:
            room.append(64 - length)
        expected.append(sorted(room))
    places = packing.best_fit(lengths, 64)
    used = {}
    for (number, offset), length, state in zip(places, lengths, expected, strict=True):
        assert used.get(number, 0) == offset
        used[number] = offset + length
        assert sorted(64 - u for u in used.values()) == state


def check_packing(docs, rows, library, window=1024):
    ids = {}
    for r in docs.collect():
        ids[r["doc_id"]] = np.frombuffer(library(r["text"] or "") + b"\0\0\0\0", "<u4")
    pieces, windows = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and 0 < r["length"] <= window
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return ids, pieces, windows


def test_packing(spark, make_docs, no_docs, library):
    rng = random.Random(2)
    docs = make_docs(
        [(n, " ".join(rng.choices(["the", "word", "xylo", "9"], k=rng.randint(0, 900)))) for n in range(300)]
        + [(900, None), (901, ""), (902, "long " * 5000)]
    )
    ids, pieces, windows = check_packing(docs, packing.pack(docs, PATH).collect(), library)
    for ident, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[ident])
    total = sum(map(len, ids.values()))
    assert len(windows) <= total / 1024 * 1.02 + 1
    assert packing.pack(no_docs, PATH).count() == 0


def test_packing_odd_rows(odd_docs):
    rows = packing.pack(odd_docs, PATH).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert sum(r["doc_id"] == 5 for r in rows) == 2
