"""Exact duplicates, owned by the terminal nodes of compressed radix tries."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprobe.llm.common import id_type, partitions, short_batches, texts
from colprobe.session import shipped_if_small, stage

# Bytes of labels that one trie holds before it spills subtrees.
TRIE_BYTES = 192 * 1024 * 1024
WHITE_SPACE = r"[\x20\x09-\x0D]+"
_WHITE = b" \t\n\r\x0b\x0c"


def normalised(text: Column) -> Column:
    """Text with every run of white space as one space."""
    return F.regexp_replace(text, WHITE_SPACE, " ")


def _normalised(text: str) -> bytes:
    raw = text.encode()
    body = b" ".join(raw.split())
    if not body:
        return b" " if raw else b""
    lead = b" " if raw[0] in _WHITE else b""
    return lead + body + (b" " if raw[-1] in _WHITE else b"")


def _merge(a: tuple, b: tuple) -> tuple:
    """Of (smallest id or None, rows with that id, rows): what both hold together."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    first = a if b[0] is None or (a[0] is not None and a[0] < b[0]) else b
    return first[0], first[1], a[2] + b[2]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving with whole comparisons."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    step = 16
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, step * 2
    high = min(high, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class PatriciaTrie:
    """Byte strings with an owner each; a node is [label, owner or None, children].

    Beyond ``limit`` bytes of labels the subtree below the heaviest first byte goes to
    a temporary file of the task, and so does what arrives for it later. Such files are
    read back one at a time, each into a trie that starts behind their common prefix.
    """

    def __init__(self, limit: int = TRIE_BYTES, skip: int = 0):
        self.limit, self.skip = limit, skip
        self.held = 0
        self.weight: dict[int, int] = {}
        self.roots: dict[int, list] = {}
        self.spilled: dict[int, list] = {}  # file, prefix that all its strings share
        self.empty: tuple | None = None

    def insert(self, key: bytes, owner: tuple) -> None:
        if len(key) <= self.skip:
            self.empty = _merge(self.empty, owner) if self.empty else owner
            return
        first = key[self.skip]
        if first in self.spilled:
            self._append(first, key, owner)
            return
        added = self._insert(first, key[self.skip :], owner)
        self.weight[first] = self.weight.get(first, 0) + added
        self.held += added
        if self.held > self.limit:
            self._spill(max(self.weight, key=self.weight.__getitem__), key[: self.skip])

    def _insert(self, first: int, key: bytes, owner: tuple) -> int:
        node = self.roots.get(first)
        if node is None:
            self.roots[first] = [key, owner, {}]
            return len(key)
        while True:
            label = node[0]
            same = _common(label, key)
            if same < len(label):  # split the edge
                node[2] = {label[same]: [label[same:], node[1], node[2]]}
                node[0], node[1] = label[:same], None
            if same == len(key):
                node[1] = _merge(node[1], owner) if node[1] else owner
                return 0
            key = key[same:]
            child = node[2].get(key[0])
            if child is None:
                node[2][key[0]] = [key, owner, {}]
                return len(key)
            node = child

    def _spill(self, first: int, prefix: bytes) -> None:
        root = self.roots.pop(first)
        self.spilled[first] = [tempfile.TemporaryFile(), prefix + root[0]]
        for key, owner in self._walk(root, prefix):
            self._append(first, key, owner)
        self.held -= self.weight.pop(first)

    def _append(self, first: int, key: bytes, owner: tuple) -> None:
        spill = self.spilled[first]
        pickle.dump((key, owner), spill[0])
        spill[1] = spill[1][: _common(spill[1], key)]

    @staticmethod
    def _walk(root: list, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        todo = [(root, prefix)]
        while todo:
            (label, owner, children), above = todo.pop()
            key = above + label
            if owner:
                yield key, owner
            todo += [(child, key) for child in children.values()]

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple]]:
        """All strings with their owners; the trie is empty afterwards."""
        if self.empty:
            yield prefix, self.empty
        for first in list(self.roots):
            yield from self._walk(self.roots.pop(first), prefix)
        for file, shared in self.spilled.values():
            below = PatriciaTrie(self.limit, len(shared))
            file.seek(0)
            with file:
                while True:
                    try:
                        key, owner = pickle.load(file)
                    except EOFError:
                        break
                    below.insert(key, owner)
            yield from below.items(shared)


def _combined(kind: pa.DataType):
    """Map side: the owners of the texts of one input partition."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                trie.insert(_normalised(text), (doc_id, 1, 1))
        yield from _rows(trie, kind, whole=True)

    return combine


def _owned(kind: pa.DataType):
    """Reduce side: the owners of the strings of one (length, hash) partition."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in batches:
            names = ("body", "keep_id", "owner_rows", "group_size")
            for body, *owner in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                trie.insert(body, tuple(owner))
        yield from _rows(trie, kind, whole=False)

    return own


def _rows(trie: PatriciaTrie, kind: pa.DataType, whole: bool) -> Iterator[pa.RecordBatch]:
    found, size = [], 0

    def batch() -> pa.RecordBatch:
        key, owner = zip(*found, strict=True)
        ids, rows, copies = zip(*owner, strict=True)
        if whole:
            hashes = [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in key]
            lead = [pa.array(map(len, key), pa.int64()), pa.array(hashes, pa.int64()), pa.array(key)]
            names = ["length", "content_hash", "body"]
        else:
            lead = [pa.array([hashlib.sha256(k).hexdigest() for k in key])]
            names = ["text_sha256"]
        values = [pa.array(ids, kind), pa.array(rows, pa.int64()), pa.array(copies, pa.int64())]
        names += ["keep_id", "owner_rows", "group_size"]
        return pa.RecordBatch.from_arrays(lead + values, names=names)

    for item in trie.items():
        found.append(item)
        size += len(item[0])
        if len(found) >= 1024 or size > 8_000_000:
            yield batch()
            found, size = [], 0
    if found:
        yield batch()


def text_owners(docs: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, owner_rows, group_size) of every distinct text; staged.

    Copies within an input partition meet in a trie before the shuffle, so a text that
    makes up a third of all rows sends one string per input partition.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, ident = docs.sparkSession, id_type(docs)
    short_batches(spark)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    owner = f"keep_id {ident}, owner_rows bigint, group_size bigint"
    local = texts(docs).mapInArrow(
        _combined(kind), f"length bigint, content_hash bigint, body binary, {owner}"
    )
    dealt = local.repartition(partitions(spark), "length", "content_hash")
    return stage(dealt.mapInArrow(_owned(kind), f"text_sha256 string, {owner}"), "owners")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when they agree after every run of white space became one space;
    null counts as empty. The smallest id of a group stays; a null id stays only where
    the group has no other. Of rows that repeat the smallest id and its text one is
    kept. An empty table gives no rows.
    """
    owners = text_owners(docs)
    members = texts(docs).select(
        "doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")
    )
    owns = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    single = (
        members.join(owners, "text_sha256")
        .where(~(owns & (F.col("owner_rows") > 1)))
        .withColumn("kept", owns)
        .select(*columns)
    )
    repeated = (
        owners.where("owner_rows > 1")
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "owner_rows")))
        .select(F.col("keep_id").alias("doc_id"), "*")
        .withColumn("kept", F.col("nth") == 1)
        .select(*columns)
    )
    return single.unionByName(repeated)


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat an id together with its text, and groups in which no row has an id,
    leave one row too. Only the keys of groups of two and more are joined; they are
    broadcast where they are measured to be small.
    """
    owners = text_owners(docs).where("group_size > 1")
    key = F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))), 256)
    groups = shipped_if_small(
        stage(owners.select(F.struct("text_sha256", "keep_id", "owner_rows").alias("owner_")), "groups")
    )
    joined = docs.join(groups, key == F.col("owner_.text_sha256"), "left")
    single = F.col("owner_").isNull()
    owns = docs["doc_id"].eqNullSafe(F.col("owner_.keep_id"))
    one = F.col("owner_.owner_rows") == 1
    columns = [docs[f"`{c}`"] for c in docs.columns]
    plain = joined.where(single | (owns & one)).select(*columns)
    repeated = joined.where(owns & ~one)
    if owners.where("owner_rows > 1").isEmpty():
        return plain
    # any of the rows that repeat the smallest id serves; partial results meet early
    packed = repeated.groupBy("owner_.text_sha256").agg(F.first(F.struct(*columns)).alias("row_"))
    return plain.unionByName(packed.select("row_.*"))
