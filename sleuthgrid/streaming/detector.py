"""Structured Streaming: windowed counts, deduplication, and burst alerts with a cooldown."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..tables import read, shared_folder


def window_counts(spark: SparkSession, sf_dir: str, *, hours: int = 1, late: str = "24 hours") -> DataFrame:
    """(window_start, event_type, n, total) of events, read as a stream to its end.

    Each micro-batch writes the windows that it changed to a folder of its own; the last one counts. State of
    windows that the watermark has passed goes; rows that come later than that are left out.
    """
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = stream.groupBy(F.window("ts", f"{hours} hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))
    counts = counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")
    at = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    query.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/counts/batch={n}")).start().awaitTermination()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    found = spark.read.schema(f"{kinds}, batch int").parquet(f"{at}/counts")
    return found.groupBy("window_start", "event_type").agg(F.max(F.struct("batch", "n", "total")).alias("r")).select("window_start", "event_type", "r.n", "r.total")


def deduplicated(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first of the rows with equal keys that come within a span of each other; state goes as the watermark passes."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


STATE, ALERT = "recent array<long>, minutes array<long>, counts array<long>, last_alert long", "key long, alerted_at timestamp, hits long"
HOUR_US = 3_600_000_000


MINUTE_US = 60_000_000


def alert_times(times: list[int], recent: list[int], minutes: list[int], counts: list[int], last_alert: int | None, least: int, window_us: int, cooldown_us: int) -> tuple[list[tuple[int, int]], list[int], list[int], list[int], int | None]:
    """Alerts (time, hits) over sorted times in microseconds, and the state after them.

    The `least` newest hits tell whether there are enough; how many there are is counted by the minute, so
    that state stays small however many come. hits are those of the minutes that the window reaches into.
    """
    out = []
    minutes, counts = list(minutes), list(counts)
    for t in times:
        recent = [*[r for r in recent if r > t - window_us], t][-least:] if least else []
        if minutes and minutes[-1] == t // MINUTE_US:
            counts[-1] += 1
        else:
            minutes.append(t // MINUTE_US)
            counts.append(1)
        gone = next((i for i, m in enumerate(minutes) if (m + 1) * MINUTE_US > t - window_us), 0)
        del minutes[:gone], counts[:gone]
        if len(recent) >= least and (last_alert is None or t - last_alert >= cooldown_us):
            last_alert = t
            out.append((t, max(len(recent), sum(counts))))
    return out, recent, minutes, counts, last_alert


def burst_alerts(stream: DataFrame, key: str, at: str, *, least: int = 3, window_hours: int = 24, cooldown_hours: int = 168, late: str = "24 hours") -> DataFrame:
    """An alert when a key has `least` hits within a window, and none in the cooldown before. Works on batches too.

    A key's state is the `least` newest hits, the counts of the window's minutes and the last alert; it goes
    once the cooldown has passed on the watermark. `hits` counts all of the window's hits, to the minute at its begin.
    """

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, minutes, counts, last = state.get if state.exists else ([], [], [], None)
        times = sorted(int(t) for b in batches for t in b["_us"])
        found, recent, minutes, counts, last = alert_times(times, list(recent), list(minutes), list(counts), last, least, window_hours * HOUR_US, cooldown_hours * HOUR_US)
        state.update((recent, minutes, counts, last))
        until = (max(recent) + max(cooldown_hours, window_hours) * HOUR_US) // 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(found), "alerted_at": pd.to_datetime([t for t, _ in found], unit="us"), "hits": [n for _, n in found]})

    timed = stream.select(F.col(key).cast("long").alias("_key"), F.col(at).cast("timestamp").alias("_at")).withWatermark("_at", late).withColumn("_us", F.unix_micros("_at"))
    return timed.groupBy("_key").applyInPandasWithState(step, ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
