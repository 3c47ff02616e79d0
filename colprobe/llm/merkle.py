"""A Merkle manifest of a document table, and proofs by a recursive climb."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprobe.llm.common import ranked
from colprobe.session import shipped_if_small, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
# Levels that a stored row links over: its parent link leads so many levels up, and it
# holds the siblings on the way.
STRIDE = 4
BLOCK = ARITY**STRIDE
# Neighbouring leaves that climb through one copy of a row, so that no row that is an
# ancestor of many leaves becomes a hot key.
LANE = 6561
# No tree has more levels: 3^39 leaves.
DEEPEST = 39


@dataclass
class Manifest:
    """Stored rows, each linked by ``up`` to the ``at`` of its ancestor, and the root in hex."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def leaf(text: Column) -> Column:
    """Digest (binary) of the fields of a row, with ``text`` in place of its text."""

    def field(value: Column) -> Column:
        shown = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    fields = [field(text if name == "text" else F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def without_newlines() -> Column:
    """The text that tampering leaves, where the id is chosen for it; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.replace("text", F.lit("\n"), F.lit("")))


def _depth(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    powers = F.array(*[F.lit(ARITY**j) for j in range(DEEPEST + 1)])
    return F.size(F.filter(powers, lambda p: p < size))


def _at(top: bool, hop: int, place: Column) -> Column:
    """The name of a stored row: its kind of tree, how many strides up, its place."""
    return (place * 64 + 2 * hop + int(top)).cast("bigint")


def _hop(rows: DataFrame, hop: int) -> DataFrame:
    """One stride up: (start, size, block, low, high, digest, members) of every block.

    ``rows`` has (start, size, place, digest, low, high, more); ``low`` and ``high`` are
    the first and last leaf below. Blocks are bounded; each builds its levels by itself.
    A member has its path, the siblings left and right of it level by level.
    """
    member = F.struct("place", "digest", "low", "high", "more")
    blocks = rows.groupBy("start", F.expr(f"place div {BLOCK}").alias("block")).agg(
        F.max("size").alias("size"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.array_sort(F.collect_list(member)).alias("members"),
    )
    rise = F.least(F.lit(STRIDE), _depth(F.col("size")) - STRIDE * hop)
    blocks = blocks.withColumn("rise", rise)
    blocks = blocks.withColumn("level0", F.expr("transform(members, m -> lower(hex(m.digest)))"))
    for j in range(STRIDE):
        runs = f"sequence(0, (size(level{j}) - 1) div {ARITY})"
        run = f"sha2(array_join(slice(level{j}, p * {ARITY} + 1, {ARITY}), ''), 256)"
        above = f"CASE WHEN rise > {j} THEN transform({runs}, p -> {run}) ELSE level{j} END"
        blocks = blocks.withColumn(f"level{j + 1}", F.expr(above))
    steps = []
    for j in range(STRIDE):
        at = f"(i div {ARITY**j})"
        run = f"({at} div {ARITY} * {ARITY})"
        left = f"array_join(slice(level{j}, {run} + 1, {at} - {run}), '')"
        right = f"array_join(slice(level{j}, {at} + 2, {run} + {ARITY - 1} - {at}), '')"
        step = f"named_struct('left', unhex({left}), 'right', unhex({right}))"
        steps.append(f"CASE WHEN rise > {j} THEN {step} END")
    path = f"filter(array({', '.join(steps)}), s -> s IS NOT NULL)"
    placed = f"transform(members, (m, i) -> named_struct('own', m, 'path', {path}))"
    return blocks.select(
        "start",
        "size",
        "block",
        "low",
        "high",
        F.expr(f"unhex(level{STRIDE}[0])").alias("digest"),
        F.expr(placed).alias("members"),
    )


def _tree(rows: DataFrame, largest: int, top: bool) -> tuple[list[DataFrame], DataFrame]:
    """Stored rows of all strides, lowest first, and (start, own, digest) of every tree."""
    stored, done, hop = [], [], 0
    while True:
        blocks = stage(_hop(rows, hop), "blocks")
        goes_on = _depth(F.col("size")) > STRIDE * (hop + 1)
        out = F.lit(None).cast("bigint") if top else _at(True, 0, F.col("start"))
        up = F.when(goes_on, _at(top, hop + 1, F.col("start") + F.col("block"))).otherwise(out)
        members = blocks.select("start", up.alias("up"), F.explode("members").alias("m"))
        lowest = top and hop == 0
        place = F.col("m.own.low") if lowest else F.col("start") + F.col("m.own.place")
        subroot = F.col("m.own.digest") if lowest else F.lit(None).cast("binary")
        stored.append(
            members.select(
                _at(top, hop, place).alias("at"), "up", "m.path", subroot.alias("subroot"), "m.own.*"
            )
        )
        done.append(blocks.where(~goes_on).select("start", F.col("size").alias("own"), "digest"))
        if BLOCK ** (hop + 1) >= largest:
            return stored, reduce(DataFrame.unionByName, done)
        rows = blocks.where(goes_on).select(
            "start", "size", F.col("block").alias("place"), "digest", "low", "high", F.lit(None).alias("more")
        )
        hop += 1


def build(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """All levels over the rows of ``docs``: a tree per source, and one over the sources.

    ``altered`` is the text to be checked against the manifest, where it differs from
    the row's own; its digest is stored with the leaf. Rows of a source follow each
    other by id (nulls first; ties by digest), sources by their bytes (null first).
    Sorting moves digests, never texts. Without rows, leaves and nodes are empty and the
    root is ``None``.
    """
    other = F.lit(None).cast("string") if altered is None else altered
    tie = F.xxhash64(F.monotonically_increasing_id())  # repeated rows fall into many ranges
    leaves = docs.select(*FIELDS).withColumn("other", other)
    leaves = leaves.select(
        "doc_id",
        "source",
        leaf(F.col("text")).alias("leaf"),
        F.when(F.col("other").isNotNull(), leaf(F.col("other"))).alias("altered"),
        tie.alias("tie"),
    )
    line = ranked(stage(leaves, "leaves"), ["source"], ["doc_id", "leaf", "tie"], "line").select(
        (F.col("line") - F.col("place")).alias("start"),
        "size",
        "place",
        F.col("leaf").alias("digest"),
        F.col("line").alias("low"),
        F.col("line").alias("high"),
        F.struct("doc_id", "altered").alias("more"),
    )
    line = stage(line, "line")
    largest = line.agg(F.max("size")).first()[0] or 0
    stored, trees = _tree(line, largest, top=False)
    trees = stage(trees, "trees")
    over = ranked(trees, [], ["start"], "over").select(
        F.lit(0).cast("bigint").alias("start"),
        "size",
        "place",
        "digest",
        F.col("start").alias("low"),
        (F.col("start") + F.col("own") - 1).alias("high"),
        F.lit(None).alias("more"),
    )
    over = stage(over, "over")
    upper, roots = _tree(over, over.count(), top=True)
    root = roots.first()
    lane = F.expr(f"low div {LANE}").alias("lane")
    leaves = stored[0].select("low", lane, "up", "path", "digest", "more.*")
    nodes = reduce(DataFrame.unionByName, [s.drop("more") for s in stored[1:] + upper])
    lanes = F.sequence(F.expr(f"low div {LANE}"), F.expr(f"high div {LANE}"))
    nodes = nodes.select("at", F.explode(lanes).alias("lane"), "up", "path", "subroot")
    return Manifest(leaves, stage(nodes, "nodes"), root["digest"].hex() if root else None)


# A stored row hands its siblings on and folds what comes from below with them.
_FOLD = (
    "aggregate({path}, {below}, (below, s) -> "
    "unhex(sha2(lower(concat(hex(s.left), hex(below), hex(s.right))), 256)))"
)
_SIBLINGS = "aggregate({path}, CAST('' AS BINARY), (all, s) -> concat(all, s.left, s.right))"
_CLIMB = f"""
WITH RECURSIVE climb (line, step, at, lane, folded, siblings, subroot) MAX RECURSION LEVEL {{limit}} AS (
  SELECT low, 0, up, lane, {_FOLD.format(path="path", below="coalesce(altered, digest)")},
         {_SIBLINGS.format(path="path")}, CAST(NULL AS BINARY)
  FROM {{leaves}}
  UNION ALL
  SELECT c.line, c.step + 1, n.up, c.lane, {_FOLD.format(path="n.path", below="c.folded")},
         {_SIBLINGS.format(path="n.path")}, n.subroot
  FROM climb c JOIN {{nodes}} n ON n.at = c.at AND n.lane = c.lane
)
SELECT line, step, folded, siblings, subroot FROM climb"""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climb(manifest: Manifest) -> DataFrame:
    """(line, step, folded, siblings, subroot): every leaf on its way up; staged.

    A recursive query joins the leaves to their ancestors, stride by stride, through the
    parent links. Each row holds the siblings of one stride, not of all strides so far.
    """
    spark = manifest.leaves.sparkSession
    before = spark.conf.get(_ROW_LIMIT, None)
    spark.conf.set(_ROW_LIMIT, "-1")  # one row per leaf and stride
    try:
        rows = spark.sql(
            _CLIMB, limit=4 * DEEPEST, leaves=manifest.leaves, nodes=shipped_if_small(manifest.nodes)
        )
        return stage(rows, "climb")
    finally:
        if before is None:
            spark.conf.unset(_ROW_LIMIT)
        else:
            spark.conf.set(_ROW_LIMIT, before)


def proofs(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    The manifest is built from the rows as they are; then every leaf, that of the
    ``altered`` text where it is not null, is folded with its stored siblings up to the
    root and compared with the manifest's.

    Nulls in any field count as such (``-``), empty texts as texts; a row without an id
    is a leaf like others, and its text is never chosen for altering by its id. Texts
    are digested whole. Repeated rows are leaves of their own that lie next to each
    other; they share their leaf, not their place, so their proofs differ. An empty
    table gives no rows. Further columns of ``docs``, whatever their names, are ignored.
    """
    manifest = build(docs, altered)
    ways = climb(manifest).groupBy("line").agg(
        F.max_by("folded", "step").alias("folded"),
        F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("steps"),
        F.max("subroot").alias("subroot"),
    )
    whole = "aggregate(steps, CAST('' AS BINARY), (all, s) -> concat(all, s.siblings))"
    known = manifest.leaves.select("low", "doc_id", F.col("digest").alias("leaf"))
    root = F.lit(manifest.root).cast("string")

    def text(digest: str) -> Column:
        return F.lower(F.hex(digest))

    return known.join(ways, known["low"] == ways["line"]).select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        root.alias("root"),
        F.sha2(F.expr(f"lower(hex({whole}))"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (text("folded") == root).alias("verified"),
    )
