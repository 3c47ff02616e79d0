import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colprobe.llm import collocations as col

CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, least, first):
    """All counts in dictionaries, one phrase at a time."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        longer = [
            b
            for (other, more), b in candidates.items()
            if other == lang
            and len(more) > len(words)
            and any(more[i : i + len(words)] == words for i in range(len(more)))
        ]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, own in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["The", "the", "of", "a", "Ärger", "ärger", "x#1", "new", "york", "city", "　", "é"]
    rows = []
    for _ in range(160):
        text = ""
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(["New York City", "out of the blue", "of the", *words])
            text += rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", " "])
        rows.append((rng.choice(["en", "en", "de", None, ""]), text))
    return rows + [("fr", None), ("fr", ""), ("fr", " \t "), ("it", "lone")]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    clashing = ["f", "h", "w1", "rank", "place", "words", "score", "n"]
    return docs.select("*", F.lit(1).alias("doc_id"), *[F.lit(7).alias(c) for c in clashing])


@pytest.mark.parametrize("least,first", [(3, 2000), (2, 7), (12, 3)])
def test_phrases_are_those_of_single_counts(spark, least, first):
    rows = corpus()
    found = [tuple(r) for r in col.collocations(frame(spark, rows), least, first).collect()]
    wanted = expected(rows, least, first)
    assert sorted(found) == wanted and len(wanted) > 3


def test_full_bit_table_loses_nothing(spark, monkeypatch):
    """Where every bit is set, all phrases are counted and the answer is the same."""
    monkeypatch.setattr(col, "bit_table", lambda *_: np.full(col.SLOTS // 8, 255, np.uint8))
    rows = corpus(4)
    found = [tuple(r) for r in col.collocations(frame(spark, rows), 4, 50).collect()]
    assert sorted(found) == expected(rows, 4, 50)


def test_parts_of_counts_meet(spark, monkeypatch):
    """Tasks that hand on after every batch, and rows asked for by one copy."""
    monkeypatch.setattr(col, "PHRASES_AT_ONCE", 1)
    monkeypatch.setattr(col, "WORDS_AT_ONCE", 1)
    monkeypatch.setattr(col, "COPIES", 1)
    rows = corpus(5)
    found = [tuple(r) for r in col.collocations(frame(spark, rows), 4, 50).collect()]
    assert sorted(found) == expected(rows, 4, 50)


def test_numbers_stand_for_one_word(spark, monkeypatch):
    """A seed under which a frequent word shares its number is not used."""
    words = spark.createDataFrame(
        [("en", bytearray(b"a"), 9), ("en", bytearray(b"b"), 1), ("de", bytearray(b"a"), 2)],
        "lang string, word binary, f bigint",
    )
    real = col.hashed
    monkeypatch.setattr(
        col, "hashed", lambda w, seed: real(w, seed).withColumn("h", F.col("h") if seed > 1 else F.lit(5).cast("bigint"))
    )
    frequent, seed = col.frequent_words(words, 3)
    assert seed == 2 and [r["h"] for r in frequent.collect()] == [col.word_hash(b"a", 2)]
    assert col.frequent_words(words, 100)[1] == 0  # no frequent word, no clash


def test_places_are_the_same_in_both_forms(spark):
    rng = np.random.default_rng(1)
    numbers = rng.integers(1, 2**63 - 1, (50, 3))
    table = spark.createDataFrame([tuple(map(int, r)) for r in numbers], "w1 bigint, w2 bigint, w3 bigint")
    for k in (1, 2, 3):
        names = [f"w{j + 1}" for j in range(k)]
        own = [r[0] for r in table.select(col._slot(names)).collect()]
        assert own == col.slots([np.ascontiguousarray(numbers[:, j]) for j in range(k)]).tolist()
        bits = col.bit_table(table, names)
        assert col._is_set(bits, np.array(own)).all()
        assert np.unpackbits(bits).sum() == len(set(own))


def relation_of(spark, rows):
    """(lang, words) of phrases, one text per row and part."""
    rows = [(lang, [*words, 0]) for lang, words in rows]
    return spark.createDataFrame(rows, "lang string, words array<bigint>").repartition(len(rows))


def test_rare_phrases_are_not_handed_on(spark):
    """Phrases that can't be frequent are left out before the tasks hand on their counts."""
    rng = np.random.default_rng(2)
    often = rng.integers(1, 2**62, 5).tolist()
    rows = [("en" if n % 2 else "de", often + rng.integers(1, 2**62, 200).tolist()) for n in range(6)]
    relation = relation_of(spark, rows)
    for k in (3, 4):
        maybe = col.maybe_frequent(relation, k, 3)
        handed = {tuple(r)[1:-1] for r in col.partial_counts(relation, k, maybe).collect()}
        assert handed == {tuple(often[i : i + k]) for i in range(6 - k)}
        assert col.partial_counts(relation, k).count() > 1000
        found = {tuple(r) for r in col.phrase_counts(relation, k, 3).collect()}
        wanted = {(lang, *often[i : i + k], 3) for lang in ("en", "de") for i in range(6 - k)}
        assert found == wanted


def test_frequent_phrases_come_once_per_core(spark, monkeypatch):
    """However many parts and batches there are; they came from every part before."""
    monkeypatch.setattr(col, "PHRASES_AT_ONCE", 500)
    text = np.random.default_rng(3).integers(1, 2**62, 50).tolist()
    relation = relation_of(spark, [("en", text * 4)] * 60)
    assert relation.rdd.getNumPartitions() == 60
    handed = col.partial_counts(relation, 3, col.maybe_frequent(relation, 3, 30))
    assert handed.count() <= 50 * spark.sparkContext.defaultParallelism
    assert {r["f"] for r in handed.groupBy("w1").agg(F.sum("f").alias("f")).collect()} == {240, 180}


@pytest.mark.parametrize("least", [1, 2, 300])
def test_shared_counters_lose_nothing(spark, monkeypatch, least):
    """With few counters rare phrases pass too, and counts stay exact; counts beyond a byte."""
    monkeypatch.setattr(col, "COUNTERS", 16)
    monkeypatch.setattr(col, "COUNTERS_AT_ONCE", 8)
    rows = [("en", [7, 8, 9] * 150), ("en", [7, 8, 9] * 151), ("de", [7, 8, 9, 5, 6])]
    found = {tuple(r) for r in col.phrase_counts(relation_of(spark, rows), 3, least).collect()}
    wanted = {("en", 7, 8, 9, 301), ("en", 8, 9, 7, 299), ("en", 9, 7, 8, 299)}
    wanted |= {("de", 7, 8, 9, 1), ("de", 8, 9, 5, 1), ("de", 9, 5, 6, 1)}
    assert found == {row for row in wanted if row[-1] >= least}


def test_no_runs_have_no_phrases(spark):
    relation = relation_of(spark, [("en", [])]).where("false")
    assert not col.maybe_frequent(relation, 3, 2).any()
    assert col.phrase_counts(relation, 3, 2).count() == 0


def test_runs():
    words = np.array([5, 6, 0, 7, 8, 9, 0, 4])
    at = col.starts(words, 1)
    assert col.runs(words, at, 1).tolist() == [5, 6, 0, 7, 8, 9, 0]
    assert col.starts(words, 2).tolist() == [0, 3, 4]
    assert col.runs(words, col.starts(words, 2), 2).tolist() == [7, 8, 9, 0]
    assert col.runs(words, np.array([], int), 2).tolist() == []
    # two runs may share words: 1 2 3 and 3 4 5, where the phrase 2 3 4 is not frequent
    words = np.array([1, 2, 3, 4, 5, 6, 0])
    assert col.runs(words, np.array([0, 1, 3, 4]), 2).tolist() == [1, 2, 3, 0, 4, 5, 6, 0]


def test_whole_long_text(spark):
    rows = [("en", "far away " * 40_000 + ". far away")]
    found = [tuple(r) for r in col.collocations(frame(spark, rows), 30).collect()]
    assert found == expected(rows, 30, 2000)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    found = [tuple(r) for r in col.collocations(odd_docs, 2).collect()]
    assert sorted(found) == expected(rows, 2, 2000) and found
    assert col.collocations(odd_docs).count() == 0
    assert col.collocations(no_docs).count() == 0
