"""Exact distinct counts of columns whose values seldom repeat, without shuffling the values.

A grouped count combines hot values before the shuffle but sends every value that occurs
once. Here each task sends sorted, difference-coded slots (hashes cut to a few bits more than
the rows need) in blocks, a few bytes a value instead of a row. Slots met twice are the only
ones whose values can repeat; just the cells in such slots are grouped by value. The slots
leave cells out and decide nothing else, so the counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprobe.functions.types import Field, fields_of
from colprobe.operators.frequencies import row_digest, typed_cells
from colprobe.session import shipped_if_small, stage

# Slots that different values share by chance: at most about 2^20 at any number of rows.
LOG_CHANCE = 20
# Cells gathered by a task before it sends its blocks.
CELLS_AT_ONCE = 1 << 20
# Values a range of slots holds on average, up to 2^16 ranges; then ranges grow.
LOG_RANGE = 18
# Beyond this many repeated slots all values are grouped, as their repeats combine anyway.
MOST_SLOTS = 1 << 22


def slot_bits(rows: int) -> tuple[int, int]:
    """(bits of a slot, leading bits that name its range) for so many cells."""
    size = math.ceil(math.log2(max(rows, 2)))
    return min(63, max(size + 8, 2 * size - LOG_CHANCE)), min(16, max(size - LOG_RANGE, 0))


def packed_slots(slots: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """(column_ix, range, seen, repeated): blocks of the slots that a task met.

    ``seen`` holds the distinct slots, ``repeated`` those that the task met more than once.
    """
    shift, at_once = bits - range_bits, CELLS_AT_ONCE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        def coded(some) -> bytes:
            # byte planes of the differences: the high ones are zeros and vanish
            steps = np.diff(some, prepend=0).astype("<u8")
            return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)

        def blocks(held: list) -> Iterator[pa.RecordBatch]:
            columns = np.concatenate([c for c, _ in held])
            values = np.concatenate([v for _, v in held])
            out = []
            for column in np.unique(columns):
                found, counts = np.unique(values[columns == column], return_counts=True)
                ranges = found >> shift
                edges = [0, *(np.flatnonzero(np.diff(ranges)) + 1), len(found)]
                for start, end in zip(edges, edges[1:]):
                    part, again = found[start:end], counts[start:end] > 1
                    out.append((int(column), int(ranges[start]), coded(part), coded(part[again])))
                    if len(out) == 1024:
                        yield framed(out)
                        out = []
            if out:
                yield framed(out)

        def framed(rows: list) -> pa.RecordBatch:
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(arrays, ["column_ix", "range", "seen", "repeated"])

        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= at_once:
                yield from blocks(held)
                held, size = [], 0
        if size:
            yield from blocks(held)

    return slots.select("column_ix", "slot").mapInArrow(
        pack, "column_ix int, range int, seen binary, repeated binary"
    )


def repeated_slots(packed: DataFrame) -> DataFrame:
    """(column_ix, slot) of the slots that were met more than once, in one task or in several."""

    def unpack(block: pd.DataFrame) -> pd.DataFrame:
        import zlib

        import numpy as np

        def decoded(some: bytes):
            planes = np.frombuffer(zlib.decompress(some), np.uint8).reshape(8, -1)
            return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64))

        seen = np.sort(np.concatenate([decoded(b) for b in block["seen"]]))
        within = np.concatenate([decoded(b) for b in block["repeated"]])
        slots = np.unique(np.concatenate([seen[1:][seen[1:] == seen[:-1]], within]))
        return pd.DataFrame({"column_ix": block["column_ix"].iloc[0], "slot": slots})

    return packed.groupBy("column_ix", "range").applyInPandas(unpack, "column_ix int, slot long")


def _slotted(cells: DataFrame, bits: int) -> DataFrame:
    slot = F.shiftrightunsigned(F.xxhash64("value"), 64 - bits)
    return cells.where(F.col("value").isNotNull()).select("column_ix", "value", slot.alias("slot"))


def repeat_candidates(families: list[DataFrame], rows: int) -> list[DataFrame]:
    """The cells (column_ix, value) whose value may occur more than once, one frame per family.

    Cells left out hold values that occur exactly once in their column.
    """
    bits, range_bits = slot_bits(rows)
    slotted = [_slotted(cells, bits) for cells in families]
    slots = reduce(DataFrame.unionAll, [s.select("column_ix", "slot") for s in slotted])
    again = stage(repeated_slots(packed_slots(slots, bits, range_bits)), "slots")
    if again.count() > MOST_SLOTS:
        return [s.select("column_ix", "value") for s in slotted]
    again = shipped_if_small(again)
    return [s.join(again, ["column_ix", "slot"], "left_semi").select("column_ix", "value") for s in slotted]


def _counts(families: list[DataFrame], rows: int) -> DataFrame:
    """(column_ix, total_count, value_count, distinct_count) of cells, in families of one type."""
    totals = [
        cells.groupBy("column_ix").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("present"))
        for cells in families
    ]
    none = F.lit(0).cast("bigint")
    parts = [t.select("column_ix", "n", "present", none.alias("surplus")) for t in totals]
    for cells in repeat_candidates(families, rows):
        groups = cells.groupBy("column_ix", "value").agg(F.count(F.lit(1)).alias("freq"))
        surplus = (F.col("freq") - 1).alias("surplus")
        parts.append(groups.select("column_ix", none.alias("n"), none.alias("present"), surplus))
    return reduce(DataFrame.unionByName, parts).groupBy("column_ix").agg(
        F.sum("n").alias("total_count"),
        F.sum("present").alias("value_count"),
        F.sum(F.col("present") - F.col("surplus")).alias("distinct_count"),
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column, counts as ``frequency_metrics`` has them.

    (column_ix, column_name, total_count, missing_count, value_count, distinct_count,
    duplicate_count). Reads ``df`` three times; worth it where most values are unique, such as
    keys. Columns of an empty table count 0.
    """
    fields = fields_of(df, columns)
    if not fields:
        raise ValueError("no column to count")
    counts = _counts([cells for _, cells in typed_cells(df, fields)], df.count() * len(fields))
    names = df.sparkSession.createDataFrame(
        [(f.ix, f.name) for f in fields], "column_ix int, column_name string"
    )
    # both have one row per column
    joined = names.join(F.broadcast(counts), "column_ix", "left").fillna(0)
    return joined.select(
        "column_ix",
        "column_name",
        "total_count",
        (F.col("total_count") - F.col("value_count")).alias("missing_count"),
        "value_count",
        "distinct_count",
        (F.col("value_count") - F.col("distinct_count")).alias("duplicate_count"),
    )


def duplicate_rows(df: DataFrame, fields: list[Field] | None = None) -> DataFrame:
    """One row: (row_count, duplicate_rows), every repeat after the first; whole rows by digest."""
    digest = f"{row_digest(fields or fields_of(df))} AS value"
    counts = _counts([df.selectExpr("0 AS column_ix", digest)], df.count())
    return counts.agg(
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("value_count") - F.col("distinct_count")), F.lit(0)).alias("duplicate_rows"),
    )
