"""Near duplicates of texts by weighted Jaccard similarity of their word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprobe.llm.common import id_type, short_batches, texts
from colprobe.session import shipped_if_small, stage

SHINGLE = 5
SIMILARITY = 0.8
# Of two texts at the threshold, 1 - (1 - 0.8^5)^30 = 0.99999 share a band.
BANDS, BAND_ROWS = 30, 5
REGISTERS = BANDS * BAND_ROWS
# Largest bucket whose members of different groups are all compared.
BUCKET = 32
# Members of larger buckets that meet in one task for a shingle they share.
PREFIX_BLOCK = 1024
# Slots that tokens are counted in, how many of them are summed together, and how many
# tokens a task gathers before it hands on their counts.
SLOTS, SLOT_PART, TOKENS = 1 << 22, 1 << 14, 1 << 20
# What floating point may be off in a bound.
ROUNDING = 1e-6
REMEMBERED_WORDS = 500_000
# Names of columns that meet those of the documents.
_ID, _MULTISET = "_id_of_answer", "_multiset_of_text"

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _salt(n: int) -> np.uint64:
    return _U(n * 0x9E3779B97F4A7C15 % 2**64)


class Shingler:
    """Hashes of the five-word shingles of texts."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def shingles(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes and how often each occurs.

        Words are parted by white space. A text of one to four words is one shingle.
        """
        words = text.split()
        if not words:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        if len(self.words) > REMEMBERED_WORDS:
            self.words = {}
        known = self.words
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), _U, len(words))
        span = min(SHINGLE, len(hashes))
        total = np.full(len(hashes) - span + 1, _U(span))
        for n in range(span):
            total = _mix(total + hashes[n : n + len(total)])
        return np.unique(total, return_counts=True)


def digest(shingles: np.ndarray, counts: np.ndarray) -> int:
    """The number by which equal multisets know each other."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes() + counts.tobytes()) - (1 << 63)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketch(owner: np.ndarray, shingles: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash registers (``size`` x REGISTERS) of the multisets of ``size`` texts.

    Every shingle carries a Poisson process over time and weight. The weight axis is
    cut at 1, 2, 4, 8, ...; each interval has a process of its own whose rate is its
    length, and each point of it a place within, found by halving. A point counts for a
    multiset when its place lies below the shingle's multiplicity, so larger weights see
    the points of smaller ones and more. Points fall on registers at random, and the
    earliest point's name is what a register keeps: two multisets agree in a register
    with the probability of their weighted Jaccard similarity. Only points up to a time
    at which all registers are almost surely full are drawn; where one is not, the time
    of that text is doubled.
    """
    total = np.bincount(owner, counts, size)
    found = np.zeros((size, REGISTERS), _U)
    earliest = np.full((size, REGISTERS), np.inf)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(size)
    limit[todo] = REGISTERS * (np.log(REGISTERS) + 3) / total[todo]
    while len(todo):
        chosen = np.zeros(size, bool)
        chosen[todo] = True
        take = chosen[owner]
        _points(owner[take], shingles[take], counts[take], limit, earliest, found)
        todo = todo[np.isinf(earliest[todo]).any(1)]
        limit[todo] *= 2
        earliest[todo], found[todo] = np.inf, 0
    return found


def _points(
    owner: np.ndarray,
    shingles: np.ndarray,
    counts: np.ndarray,
    limit: np.ndarray,
    earliest: np.ndarray,
    found: np.ndarray,
) -> None:
    """Put the points up to the limit of each text on its registers."""
    low = 0  # the interval (low, low + length]
    while len(owner):
        length = max(low, 1)
        seed = _mix(shingles + _salt(low + 1))
        who, time, nth = np.arange(len(owner)), np.zeros(len(owner)), 0
        while len(who):
            nth += 1
            name = _mix(seed[who] + _salt(nth))
            bound = limit[owner[who]]
            # the gap is compared before its logarithm is taken
            soon = _uniform(name) >= np.exp((time - bound) * length)
            who, name, time, bound = who[soon], name[soon], time[soon], bound[soon]
            time = time - np.log(_uniform(name)) / length
            on = time <= bound
            who, name, time = who[on], name[on], time[on]
            put, at, when = who, name, time
            if length > 1:
                place = (_mix(name + _U(1)) & _U(length - 1)).astype(np.int64)
                below = low + place < counts[who]
                put, at, when = who[below], name[below], time[below]
            register = (_mix(at + _U(2)) % _U(REGISTERS)).astype(np.int64)
            cell = owner[put] * REGISTERS + register
            times, names = earliest.reshape(-1), found.reshape(-1)
            np.minimum.at(times, cell, when)
            first = times[cell] == when
            names[cell[first]] = at[first]
        low += length
        more = counts > low
        owner, shingles, counts = owner[more], shingles[more], counts[more]


def _bands(registers: np.ndarray) -> np.ndarray:
    """One key per band of a sketch."""
    parts = registers.reshape(len(registers), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), parts.shape[:2])
    for row in range(BAND_ROWS):
        key = _mix(key + parts[:, :, row])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, weight, bands): digest, size and band keys of each multiset."""
    from pyspark.sql.pandas.types import to_arrow_type

    short_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            each = [shingler.shingles(t) for t in batch.column("text").to_pylist()]
            size = len(each)
            if not size:
                continue
            owner = np.repeat(np.arange(size), [len(s) for s, _ in each])
            shingles = np.concatenate([s for s, _ in each])
            counts = np.concatenate([c for _, c in each])
            bands = _bands(sketch(owner, shingles, counts, size))
            weight = np.bincount(owner, counts, size).astype(np.int64)
            columns = [
                batch.column("doc_id").cast(kind),
                pa.array([digest(s, c) for s, c in each], pa.int64()),
                pa.array(weight),
                pa.FixedSizeListArray.from_arrays(bands.ravel(), BANDS).cast(pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "weight", "bands"])

    schema = f"doc_id {id_type(docs)}, node bigint, weight bigint, bands array<bigint>"
    return texts(docs).mapInArrow(run, schema)


def _multisets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, bag): the sorted shingles, each as often as it occurs, of the given nodes.

    ``nodes`` has (doc_id, node); the texts of those documents are read again.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            own = batch.column("node").to_pylist()
            rows = []
            for node, text in zip(own, batch.column("text").to_pylist(), strict=True):
                shingles, counts = shingler.shingles(text)
                if digest(shingles, counts) == node:  # ids may repeat with other texts
                    bag = np.sort(np.repeat((shingles >> _U(32)).astype("<u4"), counts))
                    rows.append((node, bag.tobytes()))
            kinds = (pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], kinds[n]) for n in (0, 1)], names=["node", "bag"]
            )

    needed = texts(docs).join(shipped_if_small(nodes), "doc_id").select("node", "text")
    return needed.mapInArrow(run, "node bigint, bag binary").dropDuplicates(["node"])


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted bags."""
    left, right = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.sort(np.concatenate([left, right]), kind="stable")
    # the smaller multiplicity of each value: match equal neighbours of the two bags
    values, counts = np.unique(left, return_counts=True)
    at = np.searchsorted(right, values)
    until = np.searchsorted(right, values, "right")
    common = int(np.minimum(counts, until - at).sum())
    return common / max(len(both) - common, 1)


def similar(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose multisets overlap enough; staged."""

    def named(end: str) -> DataFrame:
        return bags.select(F.col("node").alias(end), F.col("bag").alias(f"bag_{end}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = (batch.column(c).to_pylist() for c in ("bag_a", "bag_b"))
            near = [overlap(a, b) >= SIMILARITY for a, b in zip(*bags, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    joined = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "bag_a", "bag_b")
    return stage(joined.mapInArrow(verify, "a bigint, b bigint"), "links")


def _near_weight(a: Column, b: Column) -> Column:
    """Bags of too different sizes cannot overlap enough."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILARITY


def _pairs(pivots: DataFrame, rows: DataFrame, also: Column | None = None) -> DataFrame:
    """(a, b): the pivot of each bucket (key, pivot, pivot_weight) with other members."""
    near = (F.col("node") != F.col("pivot")) & _near_weight(F.col("weight"), F.col("pivot_weight"))
    met = rows.join(pivots, "key").where(near if also is None else near & also)
    return met.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))


def crowded(drawn: DataFrame) -> DataFrame:
    """(key, node, weight, size, score): members of buckets that hold several multisets; staged.

    The buckets are found by counts that meet early; only their keys are joined to the
    band keys of all rows. The score of a node adds up the sizes of its buckets: the
    text that others were copied from shares most with them.
    """
    banded = drawn.select("node", "weight", F.explode("bands").alias("key"))
    ends = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    keys = stage(ends.where("low != high").select("key"), "buckets")
    members = banded.join(shipped_if_small(keys), "key")
    members = stage(members.groupBy("key", "node").agg(F.min("weight").alias("weight")), "members")
    sizes = shipped_if_small(stage(members.groupBy("key").agg(F.count("*").alias("size")), "sizes"))
    sized = members.join(sizes, "key")
    scores = sized.groupBy("node").agg(F.sum("size").alias("score"))
    return stage(sized.join(shipped_if_small(stage(scores, "scores")), "node"), "crowded")


def star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's member of highest score."""
    best = F.max(F.struct("score", "node", "weight")).alias("best")
    pivots = members.groupBy("key").agg(best).select(
        "key", F.col("best.node").alias("pivot"), F.col("best.weight").alias("pivot_weight")
    )
    return _pairs(shipped_if_small(stage(pivots, "pivots")), members).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links lead to; nodes without links are left out.

    Alternates between linking all larger neighbours and all smaller neighbours of a
    node to the smallest one, until every node is linked to one root that is linked to
    none; rounds grow with the logarithm of the nodes. Neighbourhoods are never gathered.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stage(edges, "edges")
    while True:
        ends = edges.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
            edges.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up"))
        )
        ends = ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if ends.where("down > 1 OR (down > 0 AND up > 0)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.where("b > a").join(least, "a")
        large = large.select(F.col("b").alias("a"), F.col("root").alias("b")).where("a != b")
        down = stage(large, "large")
        low = down.groupBy("a").agg(F.min("b").alias("root"))
        small = (
            down.join(low, "a")
            .select(F.col("b").alias("a"), F.col("root").alias("b"))
            .unionByName(low.select("a", F.col("root").alias("b")))
            .where("a != b")
            .distinct()
        )
        edges = stage(small, "small")


def mixed_buckets(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """Members of buckets with several groups, their group and the bucket's main one; staged."""
    group = F.coalesce("root", "node").alias("group")
    rows = members.join(shipped_if_small(rooted), "node", "left")
    rows = stage(rows.select("key", "node", "weight", "size", "score", group), "grouped")
    best = F.max(F.struct("score", "node", "group")).alias("best")
    mixed = rows.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), best)
    mixed = mixed.where("low != high").select("key", F.col("best.group").alias("main"))
    return stage(rows.join(shipped_if_small(stage(mixed, "mixed")), "key"), "mixed")


def small_bucket_pairs(mixed: DataFrame) -> DataFrame:
    """(a, b): all pairs of different groups in the buckets of up to BUCKET members."""
    few = mixed.where(F.col("size") <= BUCKET).select("key", "node", "weight", "group")
    other = few.select("key", *[F.col(c).alias(f"other_{c}") for c in ("node", "weight", "group")])
    every = few.join(other, "key").where(
        (F.col("node") < F.col("other_node"))
        & (F.col("group") != F.col("other_group"))
        & _near_weight(F.col("weight"), F.col("other_weight"))
    )
    return every.select(F.col("node").alias("a"), F.col("other_node").alias("b"))


def _tokens(bag: bytes) -> np.ndarray:
    """A number for each shingle of a bag and each time it occurs, in rising order.

    The n-th occurrence of a shingle is a token of its own, so that what two bags have in
    common is the number of tokens they share.
    """
    shingles = np.frombuffer(bag, "<u4")
    nth = np.arange(len(shingles)) - np.searchsorted(shingles, shingles)
    return shingles.astype(_U) << _U(32) | nth.astype(_U)


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (_mix(tokens) & _U(SLOTS - 1)).astype(np.int64)


def _token_counts(bags: DataFrame) -> np.ndarray:
    """How many tokens of all bags fall on each of SLOTS slots: a table of fixed size."""
    names, kinds = ["part", "slot", "held"], (pa.int32(), pa.binary(), pa.binary())

    def rows(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        raw = [(part, slot.tobytes(), held.tobytes()) for part, slot, held in found]
        columns = [pa.array([r[n] for r in raw], kind) for n, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        slot, n = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.flatnonzero(np.diff(slot // SLOT_PART)) + 1
        parts = zip(np.split(slot, cuts), np.split(n, cuts), strict=True)
        return rows([(int(s[0]) // SLOT_PART, s % SLOT_PART, m) for s, m in parts])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += [_slots(_tokens(bag)) for bag in batch.column("bag").to_pylist()]
            if sum(map(len, held)) >= TOKENS:
                yield summed(held)
                held = []
        if sum(map(len, held)):
            yield summed(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slot, held in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                own = sums.setdefault(part, np.zeros(SLOT_PART, np.int64))
                own[np.frombuffer(slot, np.int64)] += np.frombuffer(held, np.int64)
        # the order of very frequent tokens does not matter
        yield rows([(p, s[:0], np.minimum(s, 2**31 - 1).astype(np.int32)) for p, s in sums.items()])

    schema = "part int, slot binary, held binary"
    parts = bags.select("bag").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    table = np.zeros(SLOTS, np.int32)
    for row in parts.select("part", "held").collect():  # SLOTS / SLOT_PART rows at most
        table[row["part"] * SLOT_PART :][:SLOT_PART] = np.frombuffer(row["held"], np.int32)
    return table


def _prefixes(nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """(token, node, weight, group, place): the rarest tokens of each node; staged.

    Two bags that overlap enough share one of the first ``weight - 0.8 weight + 1`` tokens
    of each, whatever the order of tokens, as long as all bags have the same. Tokens go
    by the count of their slot, then by themselves, so that rare ones mostly come first,
    and no more of a bag leaves its task than these. A token that is alone in its slot is
    in no other bag; it takes its place and links nothing.
    """
    own = bags.join(shipped_if_small(nodes), "node").select("node", "weight", "group", "bag")
    counts = bags.sparkSession.sparkContext.broadcast(_token_counts(own))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, places = [], []
            for bag in batch.column("bag").to_pylist():
                tokens = _tokens(bag)
                first = int((1 - SIMILARITY) * len(tokens) + ROUNDING) + 1
                held = counts.value[_slots(tokens)]
                order = np.lexsort((tokens, held))[:first]
                place = np.flatnonzero(held[order] > 1)
                picked.append(tokens[order[place]].view(np.int64))
                places.append(place)
            if not picked:
                continue
            of = pa.array(np.repeat(np.arange(len(picked)), list(map(len, picked))))
            columns = [pa.array(np.concatenate(picked))]
            columns += [batch.column(c).take(of) for c in ("node", "weight", "group")]
            columns.append(pa.array(np.concatenate(places), pa.int64()))
            names = ["token", "node", "weight", "group", "place"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "token bigint, node bigint, weight bigint, `group` bigint, place bigint"
    return stage(own.mapInArrow(cut, schema), "prefixes")


def large_bucket_pairs(mixed: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b): all pairs of different groups in the larger buckets that can overlap enough.

    Found by the rarest tokens that two nodes share, not by their buckets: what all
    variants of a template have in common is not rare. From the place of a shared token
    on, both nodes have to have tokens enough to overlap. The nodes of a token meet in
    blocks, so that no task takes all of a frequent one.
    """
    nodes = mixed.where(F.col("size") > BUCKET).select("node", "weight", "group").distinct()
    rows = _prefixes(stage(nodes, "large"), bags)
    ends = rows.groupBy("token").agg(
        F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("held")
    )
    blocks = F.ceil(F.col("held") / PREFIX_BLOCK).cast("int").alias("blocks")
    meeting = stage(ends.where("low != high").select("token", blocks), "tokens")
    rows = rows.join(shipped_if_small(meeting), "token")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    few = rows.withColumn("other_block", each)
    names = {c: f"other_{c}" for c in ("node", "weight", "group", "place", "block")}
    other = rows.select("token", *[F.col(c).alias(n) for c, n in names.items()], each.alias("block"))
    weights = F.col("weight") + F.col("other_weight")
    ahead = F.least(F.col("weight") - F.col("place"), F.col("other_weight") - F.col("other_place"))
    met = few.join(other, ["token", "block", "other_block"]).where(
        (F.col("node") < F.col("other_node"))
        & (F.col("group") != F.col("other_group"))
        & _near_weight(F.col("weight"), F.col("other_weight"))
        & (ahead * (1 + SIMILARITY) >= weights * SIMILARITY - ROUNDING)
    )
    return met.select(F.col("node").alias("a"), F.col("other_node").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, shingles, multiset) of every row.

    Two texts are linked when the multisets of their five-word shingles have a weighted
    Jaccard similarity of at least 0.8; groups are what links connect, directly or
    through others, and the smallest id of a group stays. Equal multisets are one node
    from the start, so copies are never compared. Texts that share a band of their
    sketches are candidates: first each with the most typical text of its bucket, then,
    where a bucket still holds several groups, members of different groups: all of them
    in small buckets, in larger ones all that share a rare enough shingle, without which
    they cannot be near. Every candidate is verified on the whole multisets.

    Texts without a word (null, empty, white space) are alone, and so are rows without
    an id; rows that repeat an id and its text share their answer. Texts are shingled
    whole, however long; of equally typical texts of a bucket the one with the larger
    digest is its pivot, which changes no group. ``multiset`` is the digest by which
    equal multisets know each other. An empty table gives no rows. Further columns of
    ``docs``, whatever their names, are ignored.
    """
    drawn = stage(sketches(docs), "sketches")
    usable = drawn.where("weight > 0 AND doc_id IS NOT NULL")
    reps = usable.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    reps = stage(reps, "nodes")
    members = crowded(usable)
    needed = reps.join(members.select("node").distinct(), "node").select("doc_id", "node")
    bags = stage(_multisets(docs, stage(needed, "needed")), "bags")

    tried = stage(star_pairs(members), "pairs")
    rooted = components(similar(tried, bags))
    mixed = mixed_buckets(members, rooted)
    rest = small_bucket_pairs(mixed).unionByName(large_bucket_pairs(mixed, bags)).distinct()
    rest = stage(rest.join(shipped_if_small(tried), ["a", "b"], "left_anti"), "pairs")
    rooted = components(rooted.toDF("a", "b").unionByName(similar(rest, bags)))

    nodes = reps.join(rooted, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "doc_id", "copies"
    )
    groups = nodes.groupBy("root").agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    answers = nodes.join(groups, "root").select("node", "keep_id", "group_size")
    has_group = F.col("doc_id").isNotNull() & (F.col("weight") > 0)
    keep = F.when(has_group, F.col("keep_id")).otherwise(F.col("doc_id"))
    return drawn.join(answers, "node", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.when(has_group, F.col("group_size")).otherwise(F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.col("weight").alias("shingles"),
        F.col("node").alias("multiset"),
    )


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    A row is known by its id and the multiset of its shingles, so where an id occurs with
    several texts, each has its own answer; rows that repeat both stay or go together.
    Rows without an id and texts without a word, null or empty, stay. Only ids that go
    are joined to the texts; digests are taken again only where an id has both answers.
    An empty table stays empty; further columns may have any names.
    """
    answers = stage(near_duplicates(docs).select("doc_id", "multiset", "kept"), "answers")
    named = answers.where("doc_id IS NOT NULL")
    of_id = named.groupBy("doc_id").agg(F.min("kept").alias("all"), F.max("kept").alias("some"))
    gone = stage(of_id.where("NOT all").select(F.col("doc_id").alias(_ID), "some"), "gone")
    stay = docs.join(shipped_if_small(gone.select(_ID)), docs["doc_id"] == F.col(_ID), "left_anti")
    mixed = gone.where("some").select(_ID)
    if mixed.isEmpty():
        return stay
    short_batches(docs.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            own = [digest(*shingler.shingles(t or "")) for t in batch.column("text").to_pylist()]
            columns = [*batch.columns, pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, _MULTISET])

    unsure = docs.join(shipped_if_small(stage(mixed, "mixed")), docs["doc_id"] == F.col(_ID), "left_semi")
    marked = unsure.mapInArrow(mark, T.StructType([*docs.schema, T.StructField(_MULTISET, T.LongType())]))
    kept = named.where("kept").select(F.col("doc_id").alias(_ID), F.col("multiset").alias("_kept_multiset"))
    same = (F.col("doc_id") == F.col(_ID)) & (F.col(_MULTISET) == F.col("_kept_multiset"))
    return stay.unionByName(marked.join(kept, same, "left_semi").select(*docs.columns))
