"""Structured Streaming: a table that each key enters once, and incidents that speak twice."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE, SPOKEN = "n long, last_us long", "key string, reason string, n long, at timestamp"


def tail(stream: DataFrame, key: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream whose key path doesn't hold yet, one for each key.

    The keys are the query's state, beside the source's offsets in the checkpoint, so a batch costs what it
    brings, however much path holds; files count once their batch is whole. With RocksDB as the
    state store (spark.sql.streaming.stateStore.providerClass) the keys needn't fit in memory.
    """
    return stream.dropDuplicates(key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def spoken(n: int, arrivals: int, escalate_at: int, fresh: bool) -> list[tuple[str, int]]:
    """What arrivals on top of n occurrences say: that the incident is new, and that it has reached escalate_at."""
    out = [("new", 1)] if fresh and arrivals else []
    return out + [("burst", escalate_at)] if n < escalate_at <= n + arrivals else out


def incident_stream(stream: DataFrame, key: str, at: str, *, escalate_at: int = 10, quiet_hours: int = 24 * 30, late: str = "24 hours") -> DataFrame:
    """(key, reason, n, at) when an incident is new, and once when its count reaches escalate_at. Works on batches too.

    Its state is two numbers, and goes when it was quiet for quiet_hours on the watermark: it is new after that.
    """

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        fresh, arrivals = not state.exists, 0
        for b in batches:
            arrivals, last = arrivals + len(b), max(last, int(b["_us"].max()))
        said = spoken(n, arrivals, escalate_at, fresh)
        state.update((n + arrivals, last))
        state.setTimeoutTimestamp(max(last // 1000 + quiet_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(said), "reason": [r for r, _ in said], "n": [m for _, m in said], "at": pd.to_datetime([last] * len(said), unit="us")})

    timed = stream.select(F.col(key).cast("string").alias("_key"), F.col(at).cast("timestamp").alias("_at")).where("_key is not null and _at is not null")
    timed = timed.withWatermark("_at", late).withColumn("_us", F.unix_micros("_at"))
    return timed.groupBy("_key").applyInPandasWithState(step, SPOKEN, STATE, "append", GroupStateTimeout.EventTimeTimeout)
