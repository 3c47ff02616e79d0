"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.llm.common import partitions
from colprobe.session import stage

# Bytes that a row takes beside its text.
ROW_BYTES = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows ahead of each row within its partition; streams."""
    part, ahead, row = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends = ahead + np.cumsum(size)
        columns = [
            *batch.columns,
            pa.array(np.full(len(size), part), pa.int64()),
            pa.array(ends - size, pa.int64()),
            pa.array(row + np.arange(len(size)), pa.int64()),
        ]
        row += len(size)
        ahead = int(ends[-1]) if len(size) else ahead
        yield pa.RecordBatch.from_arrays(
            columns, names=[*batch.schema.names, "part", "ahead", "row"]
        )


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Rows in the order of ``doc_id`` (nulls first; ties by checksum, then size) form one
    line of bytes, cut at equal distances; a row belongs to the shard in which it
    begins, so no shard is off its target by more than one row. Only sizes and
    checksums are sorted, never texts. Null texts have no bytes, an empty table gives
    no rows, and repeated rows lie next to each other.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select(
        "doc_id",
        (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    line = stage(sized, "sizes").repartitionByRange(partitions(docs.sparkSession), *order)
    ident = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ident}, size bigint, text_crc32 bigint, part bigint, ahead bigint, row bigint"
    line = stage(line.sortWithinPartitions(*order).mapInArrow(_running, schema), "line")

    # as many rows as the sort had partitions
    totals = line.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("total"),
    )
    placed = line.join(F.broadcast(starts), "part").select(
        *order,
        F.expr(f"int(((bytes_before + ahead) * {int(shards)}) div total)").alias("shard"),
        (F.col("rows_before") + F.col("row")).alias("place"),
    )
    # one row per shard
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
