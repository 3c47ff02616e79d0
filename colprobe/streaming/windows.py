"""Counts per window of time: tumbling windows and sessions, batch and streamed.

A stream closes a window once its watermark (latest time seen less ``delay``) has passed
the window's end: the closed window is appended to a Parquet sink, which lists each batch
once, and leaves the state. Open windows stay in the state. What is known at any moment
is closed windows and open ones together. A row later than ``delay`` counts
while its window is open; once that is closed, Spark leaves the row out and counts it
(``left_out``). Rows without a time
fall in no window.

Times without a zone are counted from 1970 as they stand, so no clock change of the
session's zone moves or merges windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from colprobe.streaming.state import read_state, start

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
# The aggregates of a window, in the order in which a state row holds them.
MEASURES = T.StructType(
    [
        T.StructField("rows", T.LongType()),
        T.StructField("present", T.LongType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("least", T.DoubleType()),
        T.StructField("most", T.DoubleType()),
    ]
)
PERIOD = T.StructType(
    [T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType())]
)


def _micros(time: str) -> str:
    """SQL for the microseconds from 1970 to a time without a zone, part by part.

    A difference of instants would put both ends into the session's zone first.
    """
    since = f"(`{time}` - {EPOCH})"
    days, hours, minutes, seconds = (
        f"EXTRACT({part} FROM {since})" for part in ("DAY", "HOUR", "MINUTE", "SECOND")
    )
    whole = f"((BIGINT({days}) * 24 + {hours}) * 60 + {minutes}) * 60000000"
    return f"{whole} + BIGINT({seconds} * 1000000)"


def _instants(df: DataFrame, time: str, key: str, value: str) -> DataFrame:
    at = F.col(time)
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        at = F.expr(f"timestamp_micros({_micros(time)})")
    return df.select(at.alias("at"), F.col(key).alias("key"), F.col(value).cast("double").alias("value"))


def _grouped(instants: DataFrame, period: Column) -> DataFrame:
    value = F.col("value")
    return instants.groupBy(period.alias("period"), "key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("present"),
        F.sum(value).alias("total"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )


def _shown(windows: DataFrame) -> DataFrame:
    """Periods as times without a zone."""

    def plain(end: str) -> Column:
        return F.expr(f"timestampadd(MICROSECOND, unix_micros(period.{end}), {EPOCH})")

    return windows.select(
        plain("start").alias("from"), plain("end").alias("until"), "key", *MEASURES.names
    )


def _period(width: str | None, gap: str | None) -> Column:
    if (width is None) == (gap is None):
        raise ValueError("name either the width of windows or the gap between sessions")
    return F.window("at", width) if width else F.session_window("at", gap)


def windowed(
    df: DataFrame, time: str, key: str, value: str, width: str | None = None, gap: str | None = None
) -> DataFrame:
    """(from, until, key, rows, present, total, least, most) of a table, times in UTC.

    ``width`` gives tumbling windows; ``gap`` gives sessions, which end ``gap`` after their
    last row.
    """
    instants = _instants(df, time, key, value).where("at IS NOT NULL")
    return _shown(_grouped(instants, _period(width, gap)))


def stream_windows(
    stream: DataFrame,
    time: str,
    key: str,
    value: str,
    path: str,
    checkpoint: str,
    delay: str,
    width: str | None = None,
    gap: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append closed windows to ``path`` and keep open ones at ``checkpoint``."""
    instants = _instants(stream, time, key, value).where("at IS NOT NULL").withWatermark("at", delay)
    writer = _grouped(instants, _period(width, gap)).writeStream.outputMode("append")
    writer = writer.format("parquet").option("path", path)
    return start(writer, stream.sparkSession, checkpoint, trigger)


def closed_windows(spark: SparkSession, path: str, key_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("period", PERIOD)]).add("key", key_type)
    return spark.read.schema(T.StructType([*schema.fields, *MEASURES.fields])).parquet(path)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    state = read_state(spark, checkpoint)
    # a session's row begins with its period and key, a tumbling window's has them in its key
    session = "sessionStartTime" in state.schema["key"].dataType.names
    place = "value" if session else "key"
    period, key = state.schema[place].dataType.names[:2]
    held = list(state.schema["value"].dataType.fields)
    lead = T.StructType(held[:2] if session else [])
    values = F.col("value").cast(T.StructType([*lead.fields, *MEASURES.fields]))
    return state.select(
        F.col(place)[period].cast(PERIOD).alias("period"),
        F.col(place)[key].alias("key"),
        *[values[name].alias(name) for name in MEASURES.names],
    )


def current_windows(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """All windows so far, closed or open.

    While the stream goes on, the sink may be one batch ahead of the state; a window found
    in both is closed.
    """
    still = open_windows(spark, checkpoint)
    closed = closed_windows(spark, path, still.schema["key"].dataType)
    same = (F.col("o.period.start") == F.col("c.period.start")) & F.col("o.key").eqNullSafe(F.col("c.key"))
    only_open = still.alias("o").join(closed.alias("c"), same, "left_anti")
    return _shown(closed.unionByName(only_open))


def left_out(query: StreamingQuery) -> int:
    """Groups of late rows that the batches still remembered by ``query`` left out."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
