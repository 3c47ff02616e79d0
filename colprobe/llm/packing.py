"""Token sequences of fixed length, packed by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprobe.llm.bpe import WORD, Encoder, vocabulary
from colprobe.llm.common import id_type, short_batches, texts
from colprobe.session import stage

# Id that ends every document.
END = 0
# Expected number of pieces that are packed together in one task.
GROUP_PIECES = 8192


class Tokens:
    """Ids of texts as arrays, by a compiled encoder of the same vocabulary."""

    def __init__(self, path: str):
        words = vocabulary(path)
        special = set(words.special.values())
        ranks = {token: i for i, token in enumerate(words.tokens) if i not in special}
        self.exact = Encoder(words)
        self.fast = None
        # the compiled encoder takes ids for ranks
        if np.all(np.diff(words.new) > 0) and len(ranks) + len(special) == words.size:
            self.fast = tiktoken.Encoding(
                "words", pat_str=WORD.pattern, mergeable_ranks=ranks, special_tokens=words.special
            )

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its patterns give up on very long runs of white space
                pass
        return np.frombuffer(self.exact.encode([text])[0], "<u4")


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


class OpenWindows:
    """Windows by remaining capacity; a segment tree over the capacities holds counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, item: tuple[int, int]) -> None:
        self.at[capacity].append(item)
        self._add(capacity, 1)

    def take(self, least: int) -> tuple[int, tuple[int, int]] | None:
        """The tightest window with at least this capacity, removed from the tree."""
        count, node = self.count, least + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not count[2 * node])
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += change
            node >>= 1


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of pieces given in descending length."""
    open_, places, used = OpenWindows(window), [], 0
    for length in lengths:
        found = open_.take(length)
        if found is None:
            capacity, number, offset = window, used, 0
            used += 1
        else:
            capacity, (number, offset) = found
        places.append((number, offset))
        if capacity > length:
            open_.put(capacity - length, (number, offset + length))
    return places


def pieces(docs: DataFrame, path: str, window: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows, then what is left."""
    from pyspark.sql.pandas.types import to_arrow_type

    short_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    end = np.array([END], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = tokens(path)
        for batch in batches:
            rows, owner = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                ids = np.concatenate([ready.ids(text), end]).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(ids)))
                    owner.append(n)
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(kind).take(pa.array(owner, pa.int64())),
                    *map(pa.array, columns),
                ],
                names=["doc_id", *names],
            )

    schema = f"doc_id {id_type(docs)}, " + ", ".join(f"{n} bigint" for n in names)
    return texts(docs).mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str, window: int = 1024) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    A document is its ids and an end id. It is cut into full windows and one shorter
    piece. Pieces are dealt by hash into groups of some thousands, whatever document
    they are from; each group is packed by best-fit decreasing, which leaves a window or
    two of it open. Ties go by document and start. A null or empty text is one end id;
    repeated rows are packed each; an empty table gives no rows.
    """
    cut = stage(pieces(docs, path, window), "pieces")
    groups = cut.count() // GROUP_PIECES + 1
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    columns = [*cut.columns, "sequence_id", "offset"]

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", *order], ascending=[False, True, True, True, True], kind="stable"
        )
        places = np.array(best_fit(group["length"].tolist(), window), np.int64)
        group["sequence_id"] = (int(key[0]) << 32) + places[:, 0]
        group["offset"] = places[:, 1]
        return group[columns]

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("pack_group").applyInPandas(fill, schema)
