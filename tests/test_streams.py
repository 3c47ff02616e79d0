"""Streams and their state, windows with late rows."""

from datetime import datetime, timedelta

import pytest

from colprobe.functions.types import fields_of
from colprobe.operators import interactions
from colprobe.operators.frequencies import value_frequencies
from colprobe.session import new_path
from colprobe.streaming import state, windows


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """A folder of event files arriving in several micro-batches."""
    folder = str(tmp_path_factory.mktemp("land") / "events")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(6).write.parquet(folder)
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    )
    return events, stream


def texts(df):
    return sorted(map(str, df.collect()))


def test_streamed_frequencies_equal_batch(spark, landed):
    events, stream = landed
    checkpoint, fields = new_path(spark, "ck"), fields_of(events)
    query = state.stream_value_frequencies(stream, checkpoint)
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    counted = value_frequencies(events)
    assert texts(state.current_frequencies(spark, fields, checkpoint)) == texts(counted)
    # a restart with nothing new changes nothing
    state.stream_value_frequencies(stream, checkpoint).awaitTermination()
    assert texts(state.current_frequencies(spark, fields, checkpoint)) == texts(counted)


def test_state_is_kept_on_disk_and_the_session_left_as_it_was(spark, landed):
    checkpoint = new_path(spark, "ck")
    query = state.stream_value_frequencies(landed[1], checkpoint)
    query.awaitTermination()
    assert "rocksdbGetCount" in query.lastProgress["stateOperators"][0]["customMetrics"]
    assert spark.conf.get(state.PROVIDER, None) is None


def test_streams_at_the_same_time_add_up(spark, landed):
    """Two streams run side by side; readers add both."""
    events, stream = landed
    paths = [new_path(spark, "ck") for _ in range(2)]
    trigger = {"processingTime": "0 seconds"}
    running = [state.stream_value_frequencies(stream, path, trigger=trigger) for path in paths]
    for query in running:
        query.processAllAvailable()
    for query in running:
        query.stop()
    twice = value_frequencies(events).selectExpr("column_ix", "column_name", "value", "freq * 2 AS freq")
    assert texts(state.current_frequencies(spark, fields_of(events), *paths)) == texts(twice)


def test_nothing_is_read_before_the_first_batch(spark):
    with pytest.raises(ValueError, match="no batch"):
        state.read_state(spark, new_path(spark, "ck"))


def test_streamed_feedback_equals_batch(spark, landed):
    events, stream = landed
    names = ["user_id AS message_id", "event_type AS feedback", "ts", "event_id"]
    paths = [new_path(spark, "ck") for _ in range(2)]
    for path in paths:
        state.stream_feedback(stream.selectExpr(*names), path).awaitTermination()
    batch = interactions.feedback_latest(events.selectExpr(*names))
    assert texts(state.current_feedback(spark, paths[0])) == texts(batch)
    assert texts(state.current_feedback(spark, *paths)) == texts(batch)


DAY = datetime(2024, 3, 31)


def arrivals(spark, folder, batches):
    """A stream of one file per batch, in order."""
    schema = "ts timestamp_ntz, who string, x double"
    for number, rows in enumerate(batches):
        timed = [(at and DAY + timedelta(minutes=at), who, x) for at, who, x in rows]
        frame = spark.createDataFrame(timed, schema).coalesce(1)
        frame.write.parquet(f"{folder}/{number}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return source.option("latestFirst", False).parquet(f"{folder}/*")


def found(df):
    return sorted(
        ((r["from"] - DAY).total_seconds() / 60, (r["until"] - DAY).total_seconds() / 60, r["key"], r["rows"], r["total"])
        for r in df.collect()
    )


def run(spark, tmp_path, batches, **period):
    stream = arrivals(spark, str(tmp_path / "in"), batches)
    path, checkpoint = new_path(spark, "win"), new_path(spark, "ck")
    query = windows.stream_windows(stream, "ts", "who", "x", path, checkpoint, "30 minutes", **period)
    query.awaitTermination()
    return query, windows.current_windows(spark, path, checkpoint), path, checkpoint


def test_late_rows(spark, tmp_path):
    """One row late by less than the delay counts, one beyond it is left out and counted."""
    batches = [
        [(10, "a", 1.0), (70, "a", 2.0)],
        [(50, "a", 4.0), (200, "a", 8.0)],  # 20 minutes behind: the first hour is open
        [(210, "a", 32.0)],  # closes the first hour: 200 - 30 is past it
        [(20, "a", 16.0)],
    ]
    query, now, path, checkpoint = run(spark, tmp_path, batches, width="1 hour")
    assert found(now) == [
        (0.0, 60.0, "a", 2, 5.0), (60.0, 120.0, "a", 1, 2.0), (180.0, 240.0, "a", 2, 40.0)
    ]
    assert windows.left_out(query) == 1
    assert windows.open_windows(spark, checkpoint).count() == 1


def test_sessions_grow_and_merge_across_batches(spark, tmp_path):
    batches = [
        [(10, "a", 1.0), (35, "a", 2.0), (10, None, None)],
        [(22, "a", 4.0), (36, "b", 8.0), (None, "b", 1.0)],  # joins the two sessions of a
        [(300, "a", 16.0)],
    ]
    _, now, path, checkpoint = run(spark, tmp_path, batches, gap="15 minutes")
    expected = [
        (10.0, 25.0, None, 1, None), (10.0, 50.0, "a", 3, 7.0),
        (36.0, 51.0, "b", 1, 8.0), (300.0, 315.0, "a", 1, 16.0),
    ]
    assert sorted(found(now), key=str) == sorted(expected, key=str)
    rows = spark.read.parquet(str(tmp_path / "in") + "/*")
    assert sorted(found(windows.windowed(rows, "ts", "who", "x", gap="15 minutes")), key=str) == sorted(
        expected, key=str
    )


def test_times_without_zone_stay_as_they_are(spark):
    """The hour that Berlin skips keeps its rows."""
    rows = spark.createDataFrame(
        [(DAY + timedelta(minutes=m), "a", 1.0) for m in (90, 130, 190)],
        "ts timestamp_ntz, who string, x double",
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert [r[:2] for r in found(windows.windowed(rows, "ts", "who", "x", width="1 hour"))] == [
            (60.0, 120.0), (120.0, 180.0), (180.0, 240.0)
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_one_kind_of_period(spark):
    with pytest.raises(ValueError, match="either"):
        windows.windowed(spark.range(1).selectExpr("now() AS t", "id"), "t", "id", "id")
