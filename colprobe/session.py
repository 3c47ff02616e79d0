"""Where intermediate tables go.

Results that several jobs read (a value-frequency table, a chunk store, stream
output) are written once as Parquet. On a cluster that has to be the shared
folder named by ``spark.checkpoint.dir``: files there outlive a lost executor,
while a local folder or a cached block does not.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest table, as JSON text, that is broadcast.
SHIPPED_BYTES = 32 * 1024 * 1024
# Rows that are sent to Python together, as bytes.
BATCH_BYTES = 4 * 1024 * 1024
# How large tables of texts and vectors, whose values hardly repeat, are written: about two
# thirds of the bytes of Spark's defaults, in no more time.
COMPACT = {"compression": "zstd", "parquet.enable.dictionary": "false"}
# Places of the table that tells which keys a join asks for: 16 MB, whatever the keys.
KEY_PLACES = 1 << 27


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="colprobe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def files_of(spark: SparkSession, path: str):
    """The Hadoop file system that holds ``path``, and the path as that system takes it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_path(spark: SparkSession, name: str) -> str:
    """A path not yet in use, in a folder of its own that goes when the application ends."""
    folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, path = files_of(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{folder}/data"


def stage(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once and return a scan of it; cuts the lineage.

    The files are deleted when the application ends, or by ``discard`` of their ``path``.
    """
    path = path or new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    system, folder = files_of(spark, path)
    system.delete(folder, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes that reach Python at once, as the number of rows says little of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shipped_if_small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its measured size allows it.

    Beyond the limit the join shuffles both sides as usual.
    """
    measured = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(table) if measured <= SHIPPED_BYTES else table


def likely_among(table: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``table`` whose ``name`` is in ``keys``, and a few that share a place with one.

    For a join that shuffles both sides: rows without a partner stay where they lie. The keys
    are known by one bit each in a table of fixed size. Keys whose equal values can have
    different hashes aren't looked at.
    """
    kind = table.schema[name].dataType
    if kind != keys.schema[name].dataType or kind not in (T.StringType(), T.LongType(), T.IntegerType()):
        return table
    place = F.pmod(F.xxhash64(name), F.lit(KEY_PLACES)) + 1
    parts = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part"))
    parts = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(KEY_PLACES // 8, np.uint8)
    for row in parts.collect():  # at most KEY_PLACES / 32768 rows of 4 KB
        at = (row["part"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    shipped = table.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def asked(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False) - 1
        return pa.array((shipped.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return table.where(asked(place))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a file scan out to all cores when it has few input splits.

    Meant for inputs of costly per-row work. Large inputs have more splits than the
    cluster has cores and stay where they are. Asking for the splits of anything but a
    scan would run its shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
