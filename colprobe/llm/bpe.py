"""Byte-pair encoding through a lexicon of frequent words, exact for all others.

Frequent words with their ids are compiled into a minimal acyclic transducer: states
share suffixes, the outputs along a path add up to the number of the word, and the ids
stand in a table under that number. Tasks map the compiled file into memory. Words that
the lexicon lacks are merged by the ranks of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.llm.common import id_type, short_batches, texts
from colprobe.session import stage

# Words in the lexicon.
LEXICON_WORDS = 50_000
# Pieces of text whose ids a task remembers before it starts anew.
REMEMBERED = 200_000
# Longest word, in bytes, that is merged together with others in arrays.
TOGETHER = 256
# How the byte-level vocabulary cuts text into words.
WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# A single blank between two visible characters always begins a word.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
CANDIDATE = r" ?\p{L}+| ?\p{N}+"


# Slots of the hashed table of pairs, a power of two well above their number.
SLOTS = 1 << 19


def _slot(keys: np.ndarray) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - 19)).astype(np.int64)


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters, model = _byte_letters(), described["model"]
        ids = model["vocab"]
        raw = {i: bytes(letters[c] for c in token if c in letters) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        raw |= {i: token.encode() for token, i in self.special.items()}
        self.tokens = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.size = len(self.tokens)
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, new = (
            np.array(x, np.int64)
            for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True)
        )
        keys = left * self.size + right
        self.keys, self.new = keys, new  # in the order of ranks
        self.slots = self._slots()
        self.apart = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _slots(self) -> np.ndarray:
        """Ranks by hashed pair; a taken slot passes its pair on to the next one."""
        slots = np.full(SLOTS, len(self.keys))
        waiting, at = np.arange(len(self.keys)), _slot(self.keys)
        while len(waiting):
            free = slots[at] == len(self.keys)
            slots[at[free]] = waiting[free]
            left = slots[at] != waiting
            waiting, at = waiting[left], (at[left] + 1) % SLOTS
        return slots

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of pairs for one that never merges."""
        at, never = _slot(keys), len(self.keys)
        rank = self.slots[at]
        open_ = np.flatnonzero(rank != never)
        open_ = open_[self.keys[rank[open_]] != keys[open_]]
        while len(open_):
            at[open_] = (at[open_] + 1) % SLOTS
            rank[open_] = self.slots[at[open_]]
            open_ = open_[rank[open_] != never]
            open_ = open_[self.keys[rank[open_]] != keys[open_]]
        return rank

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers.

        Every round merges, in every unfinished word, all places of its pair of lowest
        rank; a merge can only bring forth pairs of higher rank.
        """
        done: list[bytes] = [b""] * len(words)
        short = []
        for n, word in enumerate(words):
            if len(word) > TOGETHER:
                done[n] = self._merge_long(word)
            elif word:
                short.append(n)
        if not short:
            return done
        ids = self.of_byte[np.frombuffer(b"".join(words[n] for n in short), np.uint8)]
        word = np.repeat(np.array(short), [len(words[n]) for n in short])
        never = len(self.keys)
        while len(ids):
            rank = np.full(len(ids), never)
            pair = np.flatnonzero(word[:-1] == word[1:])
            rank[pair] = self._ranks(ids[pair] * self.size + ids[pair + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(ids)])
            best = np.minimum.reduceat(rank, first)
            over = best == never
            if over.any():
                raw = ids.astype("<u4").tobytes()
                for n, start, size in zip(
                    word[first[over]].tolist(), first[over].tolist(), length[over].tolist(), strict=True
                ):
                    done[n] = raw[4 * start : 4 * (start + size)]
                going = np.repeat(~over, length)
                ids, word, rank = ids[going], word[going], rank[going]
                best, length = best[~over], length[~over]
                if not len(ids):
                    break
            hit = rank == np.repeat(best, length)
            # of places that overlap (equal symbols in a row) every other one counts
            place = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(place) != 1])
            nth = np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))
            place = place[nth % 2 == 0]
            ids[place] = self.new[rank[place]]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            ids, word = ids[keep], word[keep]
        return done

    def _merge_long(self, word: bytes) -> bytes:
        """The same for one long word, with a heap of pairs and linked symbols."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        size = len(ids)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        ranks = self._ranks(np.array(ids[:-1]) * self.size + np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < len(self.keys)]
        heapq.heapify(heap)

        def add(i: int, j: int) -> None:
            rank = self.pairs.get(ids[i] * self.size + ids[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= size or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.new[rank]), -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
                add(i, after[i])
            if before[i] >= 0:
                add(before[i], i)
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    @cached_property
    def pairs(self) -> dict[int, int]:
        return {key: rank for rank, key in enumerate(self.keys.tolist())}

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(tokens.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- lexicon ----------------------------------------------------------------------


def compile_lexicon(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """A minimal acyclic transducer of (word, ids), as the bytes of a file.

    Words arrive in byte order, so the states of a finished branch can be shared with
    equal ones at once. Edges are sorted by (state, byte); an edge's output is the
    number of words that come before those behind it.
    """
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    words: list[int] = []
    edges: list[tuple[tuple[int, int], ...]] = []

    def close(node: list) -> int:
        """Number of the shared state equal to an open node [final, [(byte, state)]]."""
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(finals)
            finals.append(node[0])
            edges.append(key[1])
            words.append(node[0] + sum(words[s] for _, s in key[1]))
        return register[key]

    path: list[list] = [[False, []]]  # the open nodes along the last word
    last, table = b"", []
    for word, ids in entries:
        shared = len(os.path.commonprefix([last, word]))
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], close(node)))
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
        table.append(ids)
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], close(node)))
    root = close(path[0])
    keys, target, output = [], [], []
    for state, own in enumerate(edges):
        passed = int(finals[state])
        for byte, child in own:
            keys.append(state * 256 + byte)
            target.append(child)
            output.append(passed)
            passed += words[child]
    ends = np.cumsum([0] + [len(i) // 4 for i in table])
    parts = [
        np.array([root, len(keys), len(finals), len(table)]),
        np.array(keys, np.int64),
        np.array(target, np.int64),
        np.array(output, np.int64),
        np.array(finals, np.int64),
        ends,
    ]
    return b"".join(p.astype("<i8").tobytes() for p in parts) + b"".join(table)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        whole = np.asarray(np.memmap(path, "<i8", "r", shape=(os.path.getsize(path) // 8,)))
        self.root, n_edges, n_states, n_words = whole[:4].tolist()
        cuts = np.cumsum([4, n_edges, n_edges, n_edges, n_states, n_words + 1])
        keys, target, output, self.finals, ends = (
            whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        )
        # the state behind each edge and its output by (state, byte); a step is one lookup
        self.target = np.full(n_states * 256, -1, np.int32)
        self.output = np.zeros(n_states * 256, np.int32)
        self.target[keys], self.output[keys] = target, output
        self.ends = (ends * 4).tolist()
        self.ids = np.memmap(path, "u1", "r")[int(cuts[-1]) * 8 :].data

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, None for those that the lexicon lacks.

        All words walk the automaton together, one byte at a time.
        """
        number = np.full(len(words), -1)
        if words:
            raw = np.frombuffer(b"".join(words) + b"\0", np.uint8)
            size = np.fromiter(map(len, words), np.int64, len(words))
            start = np.cumsum(size) - size
            who = np.arange(len(words))
            state, sums = np.full(len(words), self.root), np.zeros(len(words), np.int64)
            step = 0
            while len(who):
                ended = size[who] == step
                stop = ended & (self.finals[state] == 1)
                number[who[stop]] = sums[stop]
                edge = state * 256 + raw[start[who] + step]
                on = ~ended & (self.target[edge] >= 0)
                who, edge = who[on], edge[on]
                state, sums = self.target[edge].astype(np.int64), sums[on] + self.output[edge]
                step += 1
        ids, ends = self.ids, self.ends
        return [None if n < 0 else bytes(ids[ends[n] : ends[n + 1]]) for n in number.tolist()]


class Encoder:
    """Ids of texts as bytes; remembers the pieces between single blanks."""

    def __init__(self, words: Vocabulary, lexicon: Lexicon | None = None):
        self.words, self.lexicon = words, lexicon
        self.known: dict[str | int, bytes] = {}  # pieces
        self.learnt: dict[str, bytes] = {}  # words

    def _learn(self, pieces: list[str]) -> None:
        cut = [WORD.findall(piece) for piece in pieces]
        new = list(set(chain.from_iterable(cut)).difference(self.learnt))
        raw = [word.encode() for word in new]
        ids = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        absent = [n for n, found in enumerate(ids) if found is None]
        for n, found in zip(absent, self.words.merge([raw[n] for n in absent]), strict=True):
            ids[n] = found
        self.learnt |= zip(new, ids, strict=True)
        of = self.learnt
        self.known |= {
            piece: of[own[0]] if len(own) == 1 else b"".join([of[word] for word in own])
            for piece, own in zip(pieces, cut, strict=True)
        }

    def encode(self, batch: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.learnt = {}, {}
        pieces: list[list[str | int]] = []
        for text in batch:
            own: list[str | int] = []
            at = 0
            for found in self.words.apart.finditer(text) if self.words.apart else ():
                own += self._pieces(text[at : found.start()])
                own.append(self.words.special[found[0]])
                at = found.end()
            pieces.append(own + self._pieces(text[at:]) if at else self._pieces(text))
        new = set().union(*pieces).difference(self.known)
        special = {p for p in new if isinstance(p, int)}
        self.known |= {p: p.to_bytes(4, "little") for p in special}
        if len(new) > len(special):
            self._learn(list(new - special))
        known = self.known.__getitem__
        return [b"".join(map(known, own)) for own in pieces]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        """The text cut before every blank that stands alone between visible characters."""
        if not text:
            return []
        first, *rest = BETWEEN.split(text)
        return [first, *[" " + piece for piece in rest]]


@lru_cache(maxsize=1)
def encoder(path: str, lexicon: str) -> Encoder:
    """One per worker process and lexicon; what it learnt serves its later tasks."""
    return Encoder(vocabulary(path), Lexicon(SparkFiles.get(lexicon)))


def frequent_words(docs: DataFrame, limit: int) -> list[str]:
    """Up to ``limit`` words, the most frequent of all texts, most frequent first.

    Words are counted where they lie, then summed. How often a word has to occur follows
    from the number of words of every frequency, so only the chosen ones are gathered;
    words that are equally frequent are taken together or not at all.
    """
    word = F.explode(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).alias("word")
    counted = texts(docs).select(word).groupBy("word").agg(F.count("*").alias("times"))
    # a repeated word pays for its place, a single one does not
    counted = stage(counted.where("times > 1 AND octet_length(word) <= 64"), "words")
    # far fewer different frequencies than words
    by_times = counted.groupBy("times").agg(F.count("*").alias("words"))
    through = F.sum("words").over(W.orderBy(F.desc("times")))
    fit = by_times.withColumn("through", through).where(F.col("through") <= limit)
    least = fit.agg(F.min("times")).first()[0]
    if least is None:
        return []
    rows = counted.where(F.col("times") >= least).collect()  # at most ``limit``
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["times"], r["word"]))]


def ship_lexicon(docs: DataFrame, path: str, limit: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of ``docs`` and hand its file to all executors; its name."""
    words = sorted({word.encode() for word in frequent_words(docs, limit)})
    compiled = compile_lexicon(zip(words, vocabulary(path).merge(words), strict=True))
    name = f"lexicon-{uuid.uuid4().hex}"
    local = os.path.join(tempfile.mkdtemp(), name)
    with open(local, "wb") as file:
        file.write(compiled)
    docs.sparkSession.sparkContext.addFile(local)
    return name


def encode_decode(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    ``path`` names a byte-level tokenizer file that every node has; special tokens in a
    text become their ids. Null texts are empty and have no ids; repeated rows get a row
    each; an empty table gives no rows. The lexicon holds the ``words`` most frequent
    words of all texts and changes the speed only.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    short_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    lexicon = ship_lexicon(docs, path, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ready = vocabulary(path), encoder(path, lexicon)
        for batch in batches:
            ids = ready.encode(batch.column("text").to_pylist())
            decoded = [hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids]
            columns = [
                batch.column("doc_id").cast(kind),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array(decoded, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    schema = f"doc_id {id_type(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return texts(docs).mapInArrow(run, schema)
