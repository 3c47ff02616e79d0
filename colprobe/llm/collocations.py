"""Collocated phrases by set-oriented mining over stored occurrence relations.

Relation ``k`` holds the runs of words in which every phrase of ``k`` words is frequent, in
the order of the texts, so that the phrase after another one is its neighbour in the row.
Each step joins neighbours to phrases of one word more, counts them, and keeps of the
relation what the frequent ones cover. From three words on, phrases are first counted
roughly, in tables of fixed size, and only those that may be frequent are counted exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprobe.llm.common import partitions, ranked, short_batches
from colprobe.session import shipped_if_small, stage

LEAST = 30
LONGEST = 4
FIRST = 2_000
# A phrase goes if a longer one holds this share (percent) of its occurrences.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
# Bits of the table by which occurrences are tested for frequent phrases: a bound of 16 MB.
# Where two phrases share a bit, more is counted, and nothing is lost.
SLOTS = 1 << 27
# Counters of a rough count, and those of them that are summed together. Where two phrases
# share a counter, more is counted exactly, and nothing is lost.
COUNTERS = 1 << 22
COUNTERS_AT_ONCE = 1 << 16
# Distinct words, and phrases, that a task gathers before it hands on their counts.
WORDS_AT_ONCE = 200_000
PHRASES_AT_ONCE = 1_000_000
# Copies of a row that is looked up, so that a frequent word is no hot key.
COPIES = 8

_U = np.uint64
# Capital letters become small ones, ends of pieces line feeds, tabs blanks.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(
    bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(_ENDS) + b" "
)


def texts_by_language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of every word of every text; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def table() -> pa.RecordBatch:
            langs = np.repeat(np.arange(len(found)), [len(own) for own in found.values()])
            columns = [
                pa.array(list(found), pa.string()).take(pa.array(langs)),
                pa.array(chain.from_iterable(found.values()), pa.binary()),
                pa.array(chain.from_iterable(own.values() for own in found.values()), pa.int64()),
            ]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "f"])

        for batch in batches:
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                found.setdefault(lang, Counter()).update(text.encode().translate(_PLAIN).split())
            if sum(map(len, found.values())) > WORDS_AT_ONCE:
                yield table()
        yield table()

    short_batches(docs.sparkSession)
    counted = texts_by_language(docs).mapInArrow(run, "lang string, word binary, f bigint")
    return stage(counted.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")


def word_hash(word: bytes, seed: int) -> int:
    """A positive 63-bit number."""
    return xxhash.xxh3_64_intdigest(word, seed) >> 1


def hashed(words: DataFrame, seed: int) -> DataFrame:
    """``words`` with ``h``, the number that stands for a word in the relations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([word_hash(w, seed) for w in batch.column("word").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "h"])

    return words.select("lang", "word", "f").mapInArrow(run, "lang string, word binary, f bigint, h bigint")


def frequent_words(words: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(lang, word, f, h) of the frequent words, staged, and the seed of ``h``.

    The seed is the first under which no frequent word shares its number with another
    word, checked over all words, so that numbers stand for words exactly.
    """
    for seed in count():
        own = stage(hashed(words, seed), "hashed")
        ends = own.groupBy("h").agg(F.min("word").alias("low"), F.max("word").alias("high"), F.max("f").alias("f"))
        if ends.where((F.col("f") >= least) & ((F.col("low") != F.col("high")) | (F.col("h") == 0))).isEmpty():
            return stage(own.where(F.col("f") >= least), "frequent"), seed
    raise AssertionError("there is always another seed")


# --- relations ---------------------------------------------------------------------


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


def slots(phrase: list[np.ndarray]) -> np.ndarray:
    """Places of phrases, one array of numbers per word, in the bit table."""
    mixed = reduce(np.bitwise_xor, [_turned(w.view(_U), 17 * j + 1) for j, w in enumerate(phrase)])
    return (mixed & _U(SLOTS - 1)).astype(np.int64)


def _slot(names: list[str]) -> Column:
    """The same places by SQL functions."""
    turned = [
        F.shiftleft(n, 17 * j + 1).bitwiseOR(F.shiftrightunsigned(n, 63 - 17 * j)) for j, n in enumerate(names)
    ]
    return reduce(Column.bitwiseXOR, turned).bitwiseAND(F.lit(SLOTS - 1))


def bit_table(phrases: DataFrame, names: list[str]) -> np.ndarray:
    """One bit for each place that a phrase of ``phrases`` has; its size is fixed."""
    place = phrases.select((_slot(names) + 1).alias("place"))
    parts = place.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    table = np.zeros(SLOTS // 8, np.uint8)
    for row in parts.collect():  # at most SLOTS / 32768 rows of 4 KB
        at = (row["part"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return table


def _is_set(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def starts(words: np.ndarray, k: int) -> np.ndarray:
    """Where ``k`` words follow each other; 0 ends a run."""
    room = max(len(words) - k + 1, 0)
    return np.flatnonzero(reduce(np.logical_and, [words[j : j + room] != 0 for j in range(k)]))


def runs(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The words under two or more phrases of ``k`` words that begin one after another.

    ``at`` are the places where phrases begin, in order. Runs end with 0.
    """
    cut = np.diff(at) > 1
    first, last = at[np.r_[True, cut][: len(at)]], at[np.r_[cut, True][: len(at)]]
    first, last = first[last > first], last[last > first]
    if not len(first):
        return words[:0]
    size = last - first + k + 1
    ends = np.cumsum(size)
    place = np.repeat(first - (ends - size), size) + np.arange(size.sum())
    place[ends - 1] = 0  # any place: what ends a run is not a word
    out = words[place]
    out[ends - 1] = 0
    return out


_RELATION = "lang string, words array<bigint>"


def _rows(pairs: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    kind = pa.list_(pa.int64())
    columns = [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], kind)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "words"])


def first_relation(docs: DataFrame, frequent: DataFrame, seed: int) -> DataFrame:
    """(lang, words): runs of frequent words, those of many texts in a row; staged."""
    short_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(bit_table(frequent, ["h"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shipped.value, {b"\n": 0}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                own = by_lang.setdefault(lang, [])
                for piece in text.encode().translate(_PLAIN).split(b"\n"):
                    own += piece.split()
                    own.append(b"\n")
            rows = []
            for lang, own in by_lang.items():
                if len(known) > WORDS_AT_ONCE:
                    known = {b"\n": 0}
                new = list(set(own).difference(known))
                numbers = np.array([word_hash(w, seed) for w in new], np.int64)
                numbers[~_is_set(table, slots([numbers]))] = 0
                known.update(zip(new, numbers.tolist(), strict=True))
                words = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
                rows.append((lang, runs(words, np.flatnonzero(words), 1)))
            yield _rows(rows)

    return stage(texts_by_language(docs).mapInArrow(run, _RELATION).where("size(words) > 0"), "relation")


def next_relation(relation: DataFrame, table: np.ndarray, k: int) -> DataFrame:
    """The runs of relation ``k - 1`` in which phrases of ``k`` words are frequent; staged."""
    shipped = relation.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, words in _arrays(batch):
                at = starts(words, k)
                at = at[_is_set(shipped.value, slots([words[at + j] for j in range(k)]))]
                rows.append((lang, runs(words, at, k)))
            yield _rows(rows)

    return stage(relation.mapInArrow(run, _RELATION).where("size(words) > 0"), "relation")


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    words = batch.column("words")
    for n, lang in enumerate(batch.column("lang").to_pylist()):
        yield lang, words[n].values.to_numpy()


def _names(k: int) -> list[str]:
    return [f"w{j + 1}" for j in range(k)]


def maybe_frequent(relation: DataFrame, k: int, least: int) -> np.ndarray:
    """One bit for each counter that phrases of ``k`` words reach ``least`` times in all.

    Tasks count into tables of fixed size, which are summed part by part. A frequent
    phrase has its bit, in whichever language it is; few of the rare ones have.
    """
    enough = max(least, 1)
    kind = np.min_scalar_type(enough)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, words in _arrays(batch):
                at = starts(words, k)
                np.add.at(seen, _counter([words[at + j] for j in range(k)]), 1)
        seen = np.minimum(seen, enough).astype(kind).reshape(-1, COUNTERS_AT_ONCE)
        parts = np.flatnonzero(seen.any(axis=1))
        yield _parts(parts.tolist(), [seen[n].tobytes() for n in parts])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, seen in zip(batch.column("part").to_pylist(), batch.column("held"), strict=True):
                own = total.setdefault(part, np.zeros(COUNTERS_AT_ONCE, np.int64))
                own += np.frombuffer(seen.as_buffer(), kind)
                np.minimum(own, enough, out=own)
        yield _parts(list(total), [np.packbits(own >= enough, bitorder="little").tobytes() for own in total.values()])

    kept = "part int, held binary"
    dealt = _few_parts(relation).mapInArrow(run, kept).repartition(partitions(relation.sparkSession), "part")
    table = np.zeros((COUNTERS // COUNTERS_AT_ONCE, COUNTERS_AT_ONCE // 8), np.uint8)
    for row in dealt.mapInArrow(summed, kept).collect():  # COUNTERS bits at most
        table[row["part"]] = np.frombuffer(row["held"], np.uint8)
    return table.ravel()


def _few_parts(relation: DataFrame) -> DataFrame:
    """One part per core, as a frequent phrase comes from nearly every part, however many there are."""
    return relation.coalesce(relation.sparkSession.sparkContext.defaultParallelism)


def _counter(phrase: list[np.ndarray]) -> np.ndarray:
    return slots(phrase) & (COUNTERS - 1)


def _parts(parts: list[int], held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(held, pa.binary())], names=["part", "held"])


def partial_counts(relation: DataFrame, k: int, maybe: np.ndarray | None = None) -> DataFrame:
    """(lang, w1..wk, f) of the phrases of ``k`` words, those with a bit in ``maybe`` if given.

    Tasks sum up what they see at a time; a phrase comes once from each such part.
    """
    shipped = None
    if maybe is not None:
        relation, shipped = _few_parts(relation), relation.sparkSession.sparkContext.broadcast(maybe)

    def summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Phrases and their counts; those of a part are one each if it holds none."""
        columns = [np.concatenate(p) for p in zip(*parts, strict=True)]
        phrase = columns[:k]
        mixed = reduce(np.bitwise_xor, [_turned(w.view(_U), 17 * j + 1) for j, w in enumerate(phrase)])
        order = np.argsort(mixed)
        phrase = [w[order] for w in phrase]
        # phrases that fall on one mixed number may take turns; their counts meet later
        new = reduce(np.logical_or, [w[1:] != w[:-1] for w in phrase])
        first = np.flatnonzero(np.r_[True, new])
        if len(columns) > k:
            n = np.add.reduceat(columns[k][order], first)
        else:
            n = np.diff(np.r_[first, len(order)])
        return [*[w[first] for w in phrase], n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[list[np.ndarray]]] = {}
        known: dict[str, list[np.ndarray]] = {}
        size: Counter = Counter()

        def count_held() -> None:
            size.clear()
            for lang in list(held):
                own = summed(held.pop(lang))
                known[lang] = summed([known[lang], own]) if lang in known else own

        def tables() -> Iterator[pa.RecordBatch]:
            for lang in list(known):
                columns = known.pop(lang)
                own = pa.array([lang]).take(pa.array(np.zeros(len(columns[0]), np.int32)))
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, columns)], names=["lang", *_names(k), "f"])

        for batch in batches:
            for lang, words in _arrays(batch):
                at = starts(words, k)
                if shipped is not None:
                    at = at[_is_set(shipped.value, _counter([words[at + j] for j in range(k)]))]
                if len(at):
                    held.setdefault(lang, []).append([words[at + j] for j in range(k)])
                    size[lang] += len(at)
            if size.total() > PHRASES_AT_ONCE:
                count_held()
                # most phrases that may be frequent come again, others don't
                if shipped is None or sum(len(own[k]) for own in known.values()) > PHRASES_AT_ONCE:
                    yield from tables()
        count_held()
        yield from tables()

    schema = ", ".join(["lang string", *[f"{w} bigint" for w in _names(k)], "f bigint"])
    return relation.mapInArrow(run, schema)


def phrase_counts(relation: DataFrame, k: int, least: int) -> DataFrame:
    """(lang, w1..wk, f) of the phrases of ``k`` words that occur often enough; staged."""
    # too many different phrases of two words for a table of fixed size
    seen = partial_counts(relation, k, maybe_frequent(relation, k, least) if k > 2 else None)
    keys = ["lang", *_names(k)]
    # tasks have summed up already; dealt out first, rows are summed only once more
    dealt = seen.repartition(partitions(relation.sparkSession), *keys)
    return stage(dealt.groupBy(*keys).agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrases")


def frequent_phrases(docs: DataFrame, words: DataFrame, seed: int, least: int) -> list[DataFrame]:
    """(lang, w1..wk, f) of the frequent phrases of 2, 3, ... LONGEST words."""
    relation, found = first_relation(docs, words, seed), []
    for k in range(2, LONGEST + 1):
        found.append(phrase_counts(relation, k, least))
        if k < LONGEST:
            relation = next_relation(relation, bit_table(found[-1], _names(k)), k)
    return found


# --- scores ------------------------------------------------------------------------


def _padded(phrases: DataFrame, names: list[str], f: str, width: int = LONGEST) -> DataFrame:
    """(lang, w1..w<width>, f) with 0 for the words that shorter phrases lack."""
    every = [F.col(n).alias(f"w{j + 1}") for j, n in enumerate(names)]
    every += [F.lit(0).cast("bigint").alias(f"w{j + 1}") for j in range(len(names), width)]
    return phrases.select("lang", *every, f)


def _looked_up(rows: DataFrame, table: DataFrame, on: dict[str, str], value: str, name: str) -> DataFrame:
    """``rows`` with ``value`` of the row of ``table`` that ``on`` (column to column) names.

    A row of the table stands in COPIES parts and a row that asks goes to one of them.
    """
    many = table.select(
        *[F.col(own).alias(f"_{own}") for own in on.values()],
        F.col(value).alias(name),
        F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("_copy"),
    )
    same = reduce(Column.__and__, [F.col(asked) == F.col(f"_{own}") for asked, own in on.items()])
    rows = rows.withColumn("_of", F.pmod(F.xxhash64(*rows.columns), F.lit(COPIES)).cast("int"))
    return rows.join(many, same & (F.col("_of") == F.col("_copy"))).drop("_of", "_copy", *[f"_{o}" for o in on.values()])


def scored(phrases: list[DataFrame], words: DataFrame) -> DataFrame:
    """(lang, w1..w4, a, l, r, score) of every phrase, by its lowest-scoring cut; staged."""
    every = [_padded(words, ["h"], "f", LONGEST - 1)]
    every += [_padded(p, _names(k), "f", LONGEST - 1) for k, p in enumerate(phrases[:-1], 2)]
    parts = reduce(DataFrame.unionByName, every)
    cuts = []
    for k, own in enumerate(phrases, 2):
        whole = _padded(own.withColumnRenamed("f", "a"), _names(k), "a")
        for at in range(1, k):
            sides = {}
            for side, chosen in (("l", range(1, at + 1)), ("r", range(at + 1, k + 1))):
                for j in range(1, LONGEST):
                    word = F.col(f"w{chosen[j - 1]}") if j <= len(chosen) else F.lit(0).cast("bigint")
                    sides[f"{side}{j}"] = word
            cuts.append(whole.select("*", F.lit(at).alias("cut"), *[c.alias(n) for n, c in sides.items()]))
    rows = reduce(DataFrame.unionByName, cuts)
    for side in ("l", "r"):
        on = {"lang": "lang"} | {f"{side}{j}": f"w{j}" for j in range(1, LONGEST)}
        rows = _looked_up(rows, parts, on, "f", side)
        rows = rows.drop(*[f"{side}{j}" for j in range(1, LONGEST)])
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} div (l + r)").cast("bigint")
    cut = F.struct(score.alias("score"), "cut", "l", "r")
    best = rows.groupBy("lang", *_names(LONGEST), "a").agg(F.min(cut).alias("best"))
    return stage(best.select("lang", *_names(LONGEST), "a", "best.l", "best.r", "best.score"), "scored")


def not_covered(rows: DataFrame, phrases: list[DataFrame]) -> DataFrame:
    """The rows that no longer phrase covers: that holds most of their occurrences."""
    inner = []
    for k, own in enumerate(phrases[1:], 3):
        for size in range(2, k):
            for at in range(k - size + 1):
                inner.append(_padded(own, [f"w{at + j + 1}" for j in range(size)], "f"))
    longest = reduce(DataFrame.unionByName, inner).groupBy("lang", *_names(LONGEST)).agg(F.max("f").alias("most"))
    covered = F.col("most") * 100 >= F.col("a") * COVERED
    joined = rows.join(longest, ["lang", *_names(LONGEST)], "left")
    return joined.where(~F.coalesce(covered, F.lit(False))).drop("most")


def _spelled(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): numbers turned into words again."""
    spots = F.filter(F.array(*_names(LONGEST)), lambda w: w != 0)
    each = rows.select("*", F.posexplode(spots).alias("spot", "h"))
    each = _looked_up(each, words.select("lang", "h", F.col("word").cast("string").alias("word")),
                      {"lang": "lang", "h": "h"}, "word", "word")
    own = each.groupBy("lang", *_names(LONGEST), "a", "l", "r", "score").agg(
        F.array_sort(F.collect_list(F.struct("spot", "word"))).alias("spelled")
    )
    phrase = F.array_join(F.transform("spelled", lambda s: s["word"]), " ").alias("phrase")
    return own.select("lang", phrase, "a", "l", "r", "score")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to 4 words per language.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at
    blanks and tabs; A to Z become small, other letters stay. ``a`` counts a phrase
    within pieces, overlaps included, and has to reach ``least``; ``n`` counts all words
    of the language. The cut into two parts, with counts ``l`` and ``r``, that gives the
    lowest ``score``, floor(2000000 a / (l + r)), counts; of equal ones the earliest. A
    phrase inside a longer one with at least 80 % of its occurrences is left out. Ranks
    go by score, then ``a``, then the bytes of the phrase, so there are no ties.

    A null language is ``und``, a null text empty. Whole texts are read, however long;
    repeated rows count as often as they occur, with or without an id, which isn't used.
    An empty table, or one without frequent phrases, gives no rows. Further columns of
    ``docs``, whatever their names, are ignored.
    """
    counts = word_counts(docs)
    totals = stage(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words, seed = frequent_words(counts, least)
    phrases = frequent_phrases(docs, words, seed, least)
    rows = stage(_spelled(not_covered(scored(phrases, words), phrases), words), "spelled")
    order = ["by_score", "by_a", "phrase"]
    rows = rows.select("*", (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_a"))
    best = ranked(rows, ["lang"], order, "ranks").where(F.col("place") < first)
    return best.join(shipped_if_small(totals), "lang").select(
        "lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
