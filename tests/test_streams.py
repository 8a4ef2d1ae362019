"""Streams over several files, late frames and empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import temporal
from lumenlake.plans import frame_queries
from lumenlake.streaming import frames

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 1, 1)


def made(n):
    rng = random.Random(3)
    return [(i, START + dt.timedelta(minutes=7 * i), i % 4, rng.choice(["click", "view", "purchase"]), rng.random() * 300, "{}") for i in range(n)]


def expected(rows):
    alpha, ema, count, last = temporal.smoothing(), {}, {}, {}
    for _, _, user, kind, value, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        v = min(value, 255.0)
        ema[user] = v if user not in ema else alpha * v + (1 - alpha) * ema[user]
        count[user] = count.get(user, 0) + 1
        last[user] = kind if kind in ("click", "view") else last.get(user)
    return {u: (count[u], pytest.approx(ema[u], abs=2e-3)) for u in ema}, last


@pytest.mark.parametrize("files", [1, 5])
def test_a_table_of_files(spark, tmp_path, files):
    rows = made(300)
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(f"{tmp_path}/events.parquet")
    ema, last = expected(rows)
    assert {r.recording: (r.frames, r.ema) for r in frame_queries.stream_ema_state(spark, str(tmp_path)).collect()} == ema
    assert {r.recording: r.held for r in frame_queries.stream_held_detection(spark, str(tmp_path)).collect()} == last
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(frame_queries.stream_event_counts(spark, str(tmp_path))) == key(frame_queries.event_tumbling(spark, str(tmp_path)))


def test_frames_out_of_order_in_two_batches(spark, tmp_path):
    """The second batch brings frames that belong between those of the first."""
    rows = made(40)
    first, second = rows[::2] + rows[30:36:2], rows[1::2]
    first = list(dict.fromkeys(first))
    folder = str(tmp_path / "events.parquet")
    for part in (first, second):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    raw = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = frames.to_table(frames.smoothed(raw, temporal.smoothing(), late="10 hours"), "update")
    assert out.agg(F.max("batch")).first()[0] >= 1
    got = out.groupBy("recording").agg(F.max_by(F.struct("frames", "ema"), "batch").alias("v"))
    assert {r.recording: (r.v.frames, r.v.ema) for r in got.collect()} == expected(rows)[0]
    out = frames.to_table(frames.held(raw, late="10 hours"), "update")
    got = out.groupBy("recording").agg(F.max_by("held", "batch").alias("held"))
    assert {r.recording: r.held for r in got.collect()} == expected(rows)[1]


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    for query in (frame_queries.stream_event_counts, frame_queries.stream_ema_state, frame_queries.stream_held_detection):
        assert query(spark, str(tmp_path)).count() == 0
