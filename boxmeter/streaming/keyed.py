"""State per key that expires: the last value of each key until the key has been quiet for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boxmeter.streaming.limiter import _SHIFT

STRETCH = "key string, value string, first_at timestamp, last_at timestamp, n long"


def stretches_batch(events: DataFrame, quiet: int) -> DataFrame:
    """key, value (the last one), first_at, last_at, n: each stretch of a key's events (key, at, value) without a pause over ``quiet`` seconds."""
    e = events.filter("key IS NOT NULL AND at IS NOT NULL").select("key", F.col("at").cast("timestamp").alias("at"), "value")
    order = Window.partitionBy("key").orderBy("at", "value")
    pause = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(order) > quiet * 1_000_000
    marked = e.withColumn("s", F.sum(F.coalesce(pause, F.lit(True)).cast("int")).over(order))
    return marked.groupBy("key", "s").agg(
        F.max(F.struct("at", "value")).alias("last"), F.min("at").alias("first_at"), F.count("*").alias("n")
    ).select("key", "last.value", "first_at", F.col("last.at").alias("last_at"), "n")


def stretches_stream(events: DataFrame, quiet: int, late: str) -> DataFrame:
    """``stretches_batch`` on a stream: a stretch comes out once the watermark is ``quiet`` seconds behind its last event, and its state is forgotten.

    Events that arrive out of order within ``late`` join the stretch; it is
    closed by time, so two stretches of a key are told apart in order of arrival.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, first, last, n = state.get if state.exists else (None, None, None, 0)
        done = []
        if state.hasTimedOut:
            done.append((key[0], value, first, last, n))
            n = 0
        else:
            rows = sorted(((int(a), v) for b in batches for a, v in zip(b["micros"], b["value"])), key=lambda r: (r[0], r[1] is not None, r[1]))
            for at, v in rows:
                if n and at - last > quiet * 1_000_000:
                    done.append((key[0], value, first, last, n))
                    n = 0
                value, first, last, n = (v, at, at, 1) if not n else (v if at >= last else value, min(first, at), max(last, at), n + 1)
        if done:
            out = pd.DataFrame(done, columns=["key", "value", "first_at", "last_at", "n"])
            for c in ("first_at", "last_at"):
                out[c] = pd.to_datetime(out[c], unit="us", utc=True)
            yield out
        if n:
            state.update((value, first, last, n))
            state.setTimeoutTimestamp(max(last // 1000 + (quiet + _SHIFT) * 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()

    e = events.filter("key IS NOT NULL AND at IS NOT NULL").select("key", F.col("at").cast("timestamp").alias("at"), "value")
    timed = e.withColumn("micros", F.unix_micros("at")).withColumn("at", F.timestamp_micros(F.col("micros") + _SHIFT * 1_000_000)).withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(update, STRETCH, "value string, first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
