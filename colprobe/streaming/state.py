"""Profiles and feedback kept up to date from streams, in Spark's own state.

A stream is an aggregation whose result lives in its state store: partial counts per
task, merged under the key, kept on disk (RocksDB) and saved with the checkpoint. What has
been counted so far is read back from the checkpoint. Spark commits a batch whole or not
at all, so a batch repeated after a failure counts once. Streams share nothing: each has a
checkpoint of its own, and readers add up as many of them as they name.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from colprobe.functions.types import Field, fields_of, per_field
from colprobe.operators.frequencies import metrics_from_counts, text_cells
from colprobe.session import files_of

ONCE = {"availableNow": True}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state on disk, unless the session names a store."""
    if spark.conf.get(PROVIDER, None):
        yield
        return
    spark.conf.set(PROVIDER, ON_DISK)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER)


def start(writer: DataStreamWriter, spark: SparkSession, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """Start a stream; by default what there is is taken in once."""
    with state_on_disk(spark):
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def _keep(counted: DataFrame, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    # the result is the state itself, so changed rows need no sink
    writer = counted.writeStream.outputMode("update").format("noop")
    return start(writer, counted.sparkSession, checkpoint, trigger)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, value) of an aggregation as of the last batch that was committed."""
    system, commits = files_of(spark, f"{checkpoint}/commits")
    if not system.exists(commits) or not len(system.listStatus(commits)):
        raise ValueError(f"no batch has been finished at {checkpoint}")
    return spark.read.format("statestore").load(checkpoint).select("key", "value")


def _union(spark: SparkSession, checkpoints: tuple[str, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, [read_state(spark, c) for c in checkpoints])


def stream_value_frequencies(
    stream: DataFrame, checkpoint: str, digest_text: bool = False, trigger: dict | None = None
) -> StreamingQuery:
    """Count every value of every column of a stream.

    ``digest_text`` keeps long texts as digests, enough for all metrics. ``trigger`` is
    what ``DataStreamWriter.trigger`` takes.
    """
    cells = text_cells(stream, fields_of(stream), digest_text)
    counted = cells.groupBy("column_ix", "value").agg(F.count(F.lit(1)).alias("freq"))
    return _keep(counted, checkpoint, trigger)


def stream_feedback(
    stream: DataFrame, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the latest feedback per message; ``stream`` is as in ``feedback_latest``."""
    last = stream.groupBy("message_id").agg(F.max(F.struct("ts", "event_id", "feedback")).alias("last"))
    return _keep(last, checkpoint, trigger)


def current_frequencies(spark: SparkSession, fields: list[Field], *checkpoints: str) -> DataFrame:
    """(column_ix, column_name, value, freq) of everything counted at the checkpoints."""
    # a state row holds the count under the name of its aggregate
    rows = _union(spark, checkpoints).select("key.column_ix", "key.value", F.col("value.count").alias("freq"))
    if len(checkpoints) > 1:
        rows = rows.groupBy("column_ix", "value").agg(F.sum("freq").alias("freq"))
    name = per_field(fields, lambda f: f.name)
    return rows.select("column_ix", name.alias("column_name"), "value", "freq")


def current_metrics(spark: SparkSession, fields: list[Field], *checkpoints: str) -> DataFrame:
    """Frequency metrics of everything streamed so far, for the fields of the stream."""
    counts = current_frequencies(spark, fields, *checkpoints)
    missing = F.col("value").isNull().alias("missing")
    return metrics_from_counts(counts.select("column_ix", missing, "freq"), fields)


def current_feedback(spark: SparkSession, *checkpoints: str) -> DataFrame:
    """(message_id, feedback, ts, event_id) last given, over all the checkpoints."""
    rows = _union(spark, checkpoints).select("key.message_id", F.col("value.max").alias("last"))
    if len(checkpoints) > 1:
        rows = rows.groupBy("message_id").agg(F.max("last").alias("last"))
    return rows.select("message_id", "last.feedback", "last.ts", "last.event_id")
