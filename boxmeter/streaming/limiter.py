"""Sliding-window admission per user, as a batch fold and as a stateful stream.

A request takes its units all or nothing if they fit into the window; rejected
requests take nothing; a unit exactly one window old is gone.  Negative units
give back the newest ones.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "event_id long, user_id long, at long, units int, admitted boolean"
_STATE = "taken_at array<long>, taken_units array<long>, event_id array<long>, at array<long>, units array<int>"

#: A stream's first watermark is 1970; times are moved behind it, so that no request is too early.
_SHIFT = 1 << 33


class Window:
    """The units taken within the window, as (time, units) in order of time."""

    def __init__(self, limit: int, window: int, taken=()):
        self.limit, self.window = limit, window
        self.taken: deque[list[int]] = deque([int(t), int(n)] for t, n in taken)
        self.held = sum(n for _, n in self.taken)

    def decide(self, at: int, units: int) -> bool:
        """Update the window and say whether the request is admitted."""
        taken = self.taken
        while taken and taken[0][0] <= at - self.window:
            self.held -= taken.popleft()[1]
        if units < 0:
            back = min(-units, self.held)
            self.held -= back
            while back:
                n = min(back, taken[-1][1])
                taken[-1][1] -= n
                back -= n
                if not taken[-1][1]:
                    taken.pop()
            return True
        if self.held + units > self.limit:
            return False
        if units:
            taken.append([at, units])
            self.held += units
        return True


def admit_batch(requests: DataFrame, limit: int, window: int) -> DataFrame:
    """Decisions on all requests (event_id, user_id, at in seconds, units), in order of at, then event_id.

    A user's requests depend on each other, so they are walked in order; they
    are sorted by the shuffle and stream through the task one batch at a time,
    so a hot user needs time but no memory.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, Window(limit, window)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.user_id != user:
                    user, held = r.user_id, Window(limit, window)
                out.append(held.decide(r.at, r.units))
            yield b.assign(admitted=out)

    ordered = requests.select("event_id", "user_id", "at", F.col("units").cast("int").alias("units")).repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return ordered.mapInPandas(walk, DECISION)


def admit_stream(requests: DataFrame, limit: int, window: int, late: str | None = None) -> DataFrame:
    """The same decisions on a stream, by the time of the requests, however far behind the stream runs.

    With ``late`` a request waits until the watermark (so far behind the newest
    request) has passed it, so that earlier ones which arrive later still come
    first: the decisions are those of ``admit_batch``, whatever the
    micro-batches.  Without it a request is decided at once, behind what has
    arrived before.  Requests behind the watermark (without ``late``: a window
    behind) are dropped.  A user is forgotten once nothing waits and the
    watermark has left the window behind.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken_at, taken_units, *waiting = state.get if state.exists else ([], [], [], [], [])
        rows = list(zip(*waiting))
        rows = [(int(e), int(a), int(u)) for e, a, u in rows]
        if not state.hasTimedOut:
            rows += [(int(r.event_id), int(r.at), int(r.units)) for b in batches for r in b.itertuples(index=False)]
        rows.sort(key=lambda r: (r[1], r[0]))
        mark = state.getCurrentWatermarkMs() - _SHIFT * 1000
        held = Window(limit, window, zip(taken_at, taken_units))
        due = 0
        out = []
        while due < len(rows) and (late is None or rows[due][1] * 1000 < mark):
            e, a, u = rows[due]
            out.append((e, key[0], a, u, held.decide(a, u)))
            due += 1
        rows = rows[due:]
        while not rows and held.taken and (held.taken[0][0] + window) * 1000 <= mark:
            held.taken.popleft()
        if out:
            yield pd.DataFrame(out, columns=["event_id", "user_id", "at", "units", "admitted"])
        if not rows and not held.taken:
            if state.exists:
                state.remove()
            return
        state.update(([t for t, _ in held.taken], [n for _, n in held.taken], [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        wake = rows[0][1] if rows else held.taken[-1][0] + window
        state.setTimeoutTimestamp(max(wake * 1000, mark) + _SHIFT * 1000 + 1)

    typed = requests.select("event_id", "user_id", F.col("at").cast("long").alias("at"), F.col("units").cast("int").alias("units"))
    timed = typed.withColumn("time", F.timestamp_seconds(F.col("at") + _SHIFT)).withWatermark("time", late or f"{window} seconds")
    return timed.groupBy("user_id").applyInPandasWithState(update, DECISION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
