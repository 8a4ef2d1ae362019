"""Streaming twins of the sequence operators: windowed counts, sessions, smoothing and held detections with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenlake.sources.shared import remove, scratch


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, a file or a folder of files, as a stream. Its times have no zone, and watermarks need one: the session's."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    # a stream reads folders; a pattern lets it read a table of a single file too
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def _folded(values: np.ndarray, n: int, ema: float, alpha: float) -> tuple[int, float]:
    """The exponential mean after values in order: a weighted sum, no loop."""
    if not len(values):
        return n, ema
    if n == 0:
        n, ema, values = 1, float(values[0]), values[1:]
    keep = (1 - alpha) ** np.arange(len(values) - 1, -1, -1)
    return n + len(values), float(ema * (1 - alpha) ** len(values) + alpha * (keep @ values))


def smoothed(stream: DataFrame, alpha: float, late: str = "2 hours", idle_hours: int = 24 * 365) -> DataFrame:
    """The exponential mean of value per user and the number of frames so far; the value goes in as luma, cut at 255.

    Frames count in order of time and id, whichever batch brings them: those behind the
    watermark are folded into two numbers, and later ones are held until they are. A frame
    that comes after the watermark has passed it is dropped. A user without a frame for
    idle_hours is forgotten and starts afresh.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema, ts, ids, values = state.get if state.exists else (0, 0.0, [], [], [])
        held = pd.DataFrame({"at": np.array(ts, dtype=np.int64), "event_id": np.array(ids, dtype=np.int64), "value": np.array(values, dtype=np.float64)})
        fresh = [] if state.hasTimedOut else [b[["at", "event_id", "value"]] for b in batches if len(b)]
        held = pd.concat([held, *fresh] if len(held) else fresh or [held]).sort_values(["at", "event_id"])
        held["value"] = held["value"].clip(upper=255.0)
        mark = state.getCurrentWatermarkMs()
        past = held[held["at"] < mark]
        n, ema = _folded(past["value"].to_numpy(), n, ema, alpha)
        held = held[held["at"] >= mark]
        count, level = _folded(held["value"].to_numpy(), n, ema, alpha)
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((n, ema, held["at"].tolist(), held["event_id"].tolist(), held["value"].tolist()))
            last = int(held["at"].max()) if len(held) else int(past["at"].max()) if len(past) else mark
            state.setTimeoutTimestamp(max(last, mark) + 3_600_000 * idle_hours)
        yield pd.DataFrame({"recording": [key[0]], "frames": [count], "ema": [level]})

    rows = stream.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("at"), "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(
        step, "recording long, frames long, ema double", "n long, ema double, at array<long>, ids array<long>, vs array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def held(stream: DataFrame, late: str = "2 hours", idle_hours: int = 24 * 365) -> DataFrame:
    """The last detection of each user so far, by time and id, kept while the detector skips frames; a late frame replaces none that is newer.

    A user without a frame for idle_hours is forgotten.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, number, last = state.get if state.exists else (-(2**62), 0, None)
        if state.hasTimedOut:
            state.remove()
        else:
            top = state.getCurrentWatermarkMs()
            for rows in batches:
                top = max(top, int(rows["at"].max()))
                seen = rows[rows["event_type"].isin(["click", "view"])].sort_values(["at", "event_id"])
                if len(seen) and (seen["at"].iloc[-1], seen["event_id"].iloc[-1]) > (at, number):
                    at, number, last = int(seen["at"].iloc[-1]), int(seen["event_id"].iloc[-1]), seen["event_type"].iloc[-1]
            state.update((at, number, last))
            state.setTimeoutTimestamp(top + 3_600_000 * idle_hours)
        yield pd.DataFrame({"recording": [key[0]], "held": [last]})

    rows = stream.withWatermark("ts", late).select("user_id", "ts", F.unix_millis("ts").alias("at"), "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, "recording long, held string", "at long, number long, held string", "update", GroupStateTimeout.EventTimeTimeout)


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that is there now: each batch is written to the shared folder, with its number; an empty table without any. Its checkpoints go when it has ended."""
    spark = stream.sparkSession
    out, note = scratch(spark, "stream"), scratch(spark, "stream")
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces what it left
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")
        numbers.append(number)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", note).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    remove(spark, note)
    if not numbers:
        return spark.createDataFrame([], stream.schema.add("batch", "int"))
    return spark.read.parquet(out).drop("part")
