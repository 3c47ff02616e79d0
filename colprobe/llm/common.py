"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.session import shipped_if_small, stage

# Rows that reach Python together. Whole texts travel, so batches are kept short: the
# memory of a task follows the length of its longest texts, not the number of rows.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ...) alone, so that no further column can clash; null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for the operators that take whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null where the id is null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place`` and ``size`` in their group and ``line``, the place among all.

    Groups follow each other in the order of ``group``, rows in a group in that of
    ``order``; nulls come first. Rows are sorted by ranges, so that one large group is
    spread over many tasks; what has to be summed is one row per partition, and one per
    partition and group. Staged: repeated rows must differ in the last key of ``order``
    for their ranges to be split.
    """
    keys = [*group, *order]
    sorted_ = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    spot = F.monotonically_increasing_id()  # partition and row within it
    lined = stage(sorted_.withColumn("spot", spot), name)
    part, row = F.shiftright("spot", 33), F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    lined = lined.select("*", part.alias("part"), row.alias("row")).drop("spot")
    held = stage(
        lined.groupBy("part", *group).agg(F.min("row").alias("first"), F.count("*").alias("held")), name
    )
    ahead = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = held.groupBy("part").agg(F.sum("held").alias("held"))  # one row per partition
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    held = held.select(
        F.col("part").alias("own_part"),
        *[F.col(g).alias(f"own_{g}") for g in group],
        (F.coalesce(F.sum("held").over(ahead), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(W.partitionBy(*group)).alias("size"),
    )
    same = F.col("part") == F.col("own_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"own_{g}"))
    found = lined.join(shipped_if_small(stage(held, name)), same).join(F.broadcast(parts), "part")
    return found.select(
        *rows.columns,
        (F.col("row") + F.col("shift")).alias("place"),
        "size",
        (F.col("row") + F.col("offset")).alias("line"),
    )


def draw_limit(share: float) -> int:
    """The 63-bit number below which hashes have to lie for ``share`` of them to do so."""
    return int(min(max(share, 0.0), 1.0) * 2.0**63)


def drawn(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, by 63 bits of their hash.

    Fine enough for any table: of 10^15 keys, a share for 1 000 of them still draws them.
    """
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(key), 1) < F.lit(draw_limit(share))
