"""The fixed-window limiter on a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_throttle(
    events: DataFrame, key: str, ts: str, max_rate: int = 5, window_seconds: int = 60, forget_idle: bool = False
) -> DataFrame:
    """The events with a column ``allowed``, as the batch form has them.

    The state of a key is two numbers; a trigger holds its own events per key, so limit what a trigger takes in
    (``maxFilesPerTrigger``). Events of a trigger are judged in time order; an event that comes in a later trigger than
    its time suggests is judged when it arrives. An event without a time passes by the state, with NULL. ``forget_idle``
    drops the state of a key that was at rest for two windows; that is for live streams under a processing-time
    trigger, since stored events run through faster than their own clock.
    """
    window = window_seconds * 1_000_000

    def judge(_group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, first = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("__us", kind="stable")
        times = rows["__us"].to_numpy()
        allowed = np.empty(len(times), dtype=bool)
        at = 0
        # One step per window, however many events it holds.
        while at < len(times):
            if first is None or times[at] - first > window:
                count, first = 0, int(times[at])
            # At least one event a step: a time before the open window belongs to it.
            end = max(at + 1, int(np.searchsorted(times, first + window, side="right")))
            allowed[at:end] = np.arange(end - at) < max_rate - count
            count, at = min(max_rate, count + end - at), end
        state.update((count, first))
        if forget_idle:
            state.setTimeoutDuration(2 * window_seconds * 1000)
        yield rows.drop(columns=["__k", "__us"]).assign(allowed=allowed)

    timed = events.filter(F.col(ts).isNotNull())
    timed = timed.withColumn("__k", F.col(key)).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    judged = timed.groupBy("__k").applyInPandasWithState(
        judge,
        T.StructType([*events.schema, T.StructField("allowed", T.BooleanType())]),
        "count int, first bigint",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if forget_idle else GroupStateTimeout.NoTimeout,
    )
    timeless = events.filter(F.col(ts).isNull()).select(*events.columns, F.lit(None).cast("boolean").alias("allowed"))
    return judged.unionByName(timeless)
