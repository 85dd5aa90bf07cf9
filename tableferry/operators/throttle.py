"""Fixed-window limiter over an event table: flag the events of bursty keys.

A window opens at a key's first event and at the first event more than
``window`` after the opening of the one before; the first ``max_rate`` events of
a window are allowed. Which event opens a window depends on all earlier ones of
its key, but a heavy key need not be walked in one task:

1. Time is cut into slices. In each (key, slice) the only thing that matters of
   the past is when the open window ends, so a slice is summed up as a step
   function: from that end to the opening of the last window in the slice.
   Chains that start at different events soon meet, so few steps remain.
2. Per key, the step functions are applied one after the other, which gives
   each slice the window that is open when it begins.
3. Each slice is then walked again by itself, and now the true openings are known.

Slices of one key are spread over all tasks in 1 and 3. Step 2 sees only the
steps, and streams over them with one number of state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS_PER_SLICE = 32
NEVER = -(2**62)


def throttle(
    events: DataFrame,
    key: str,
    ts: str,
    max_rate: int = 5,
    window_seconds: int = 60,
    order_by: Sequence[str] = (),
    windows_per_slice: int = WINDOWS_PER_SLICE,
) -> DataFrame:
    """The events with a column ``allowed``. ``order_by`` orders events of the same instant.

    An event without a time is kept; whether it is allowed cannot be said, so it has NULL there.
    """
    timeless = events.filter(F.col(ts).isNull()).select(*events.columns, F.lit(None).cast("boolean").alias("allowed"))
    return _judged(events.filter(F.col(ts).isNotNull()), key, ts, max_rate, window_seconds, order_by, windows_per_slice).unionByName(
        timeless
    )


def _judged(
    events: DataFrame, key: str, ts: str, max_rate: int, window_seconds: int, order_by: Sequence[str], windows_per_slice: int
) -> DataFrame:
    window = window_seconds * 1_000_000
    length = window * windows_per_slice
    # A key as text that is never NULL: then all joins below are plain equalities.
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    timed = events.withColumn("__k", text).withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    # Instants, not events: what happens at one instant happens in one window.
    instants = timed.groupBy(F.col("__k").alias("k"), F.col("__us").alias("us")).agg(F.count(F.lit(1)).alias("n"))
    instants = instants.withColumn("slice", F.floor(F.col("us") / length))

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches):
            yield slice_steps(part, window, length)

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return open_at_begin(batches, window)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches):
            yield slice_openings(part, window, length)

    def in_order(df: DataFrame, by: list[str], *rest: str) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by, *rest)

    steps = in_order(instants, ["k", "slice"], "us").mapInPandas(
        sum_up, "k string, slice bigint, upto bigint, last bigint"
    )
    carried = in_order(steps, ["k"], "slice", "upto").mapInPandas(carry, "k string, slice bigint, open_at bigint")
    known = instants.join(carried, ["k", "slice"])
    opened = in_order(known, ["k", "slice"], "us").mapInPandas(
        walk, "k string, us bigint, n bigint, opened bigint"
    )
    # Each instant holds an event at least, so what is allowed is within the first ``max_rate`` instants of a window;
    # Spark limits each window to those before it shuffles.
    in_window = Window.partitionBy("k", "opened").orderBy("us")
    front = opened.withColumn("place", F.row_number().over(in_window)).filter(F.col("place") <= max_rate)
    before = in_window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("n").over(before), F.lit(0))
    ranked = front.select(F.col("k").alias("__k"), F.col("us").alias("__us"), earlier.alias("__earlier"))
    same = Window.partitionBy("__k", "__us").orderBy(*(order_by or ["__us"]))
    return (
        timed.withColumn("__same", F.row_number().over(same))
        .join(ranked, ["__k", "__us"], "left")
        .select(
            *events.columns,
            F.coalesce(F.col("__earlier") + F.col("__same") <= max_rate, F.lit(False)).alias("allowed"),
        )
    )


def group_starts(part: pd.DataFrame) -> np.ndarray:
    """Where a new (key, slice) begins in ordered rows."""
    keys, slices = part["k"].to_numpy(dtype=object), part["slice"].to_numpy()
    return np.append(True, (keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1]))


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same ordered rows, cut so that no (key, slice) is split."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if len(held) > 1:
            first, last = held[0].iloc[0], batch.iloc[-1]
            if first["k"] == last["k"] and first["slice"] == last["slice"]:
                continue
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
        cut = int(np.flatnonzero(group_starts(rows))[-1])
        if cut:
            yield rows.iloc[:cut].reset_index(drop=True)
        held = [rows.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


class _Line:
    """The instants of many slices on one line, each slice too far from the next for a window to reach."""

    def __init__(self, part: pd.DataFrame, window: int, length: int):
        starts = group_starts(part)
        self.group = np.cumsum(starts) - 1
        self.first = np.flatnonzero(starts)
        self.end = np.append(self.first[1:], len(part))
        self.begin = part["slice"].to_numpy() * length
        self.us = part["us"].to_numpy()
        self.span = length + window + 1
        self.at = self.group * self.span + (self.us - self.begin)
        # The instant that opens the next window if this one opens a window; the slice's end if none does.
        self.follow = np.searchsorted(self.at, self.at + window, side="right")


def slice_steps(part: pd.DataFrame, window: int, length: int) -> pd.DataFrame:
    """Each slice's steps: ``last`` follows when the first instant after the open window is at most ``upto``.

    A window open when the slice begins ends within one ``window``, so the
    first opening is an instant up to then or the next one after.
    """
    line = _Line(part, window, length)
    end = line.end[line.group]
    index = np.arange(len(part))
    jump = np.where(line.follow < end, line.follow, index)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    last = line.us[jump]
    reach = np.searchsorted(line.at, np.arange(len(line.first)) * line.span + window, side="right")
    can_be_first = index <= np.minimum(reach, line.end - 1)[line.group]
    rows = np.flatnonzero(can_be_first)
    edge = np.append((last[rows][1:] != last[rows][:-1]) | (line.group[rows][1:] != line.group[rows][:-1]), True)
    kept = rows[edge]
    return pd.DataFrame(
        {"k": part["k"].to_numpy()[kept], "slice": part["slice"].to_numpy()[kept], "upto": line.us[kept], "last": last[kept]}
    )


def open_at_begin(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Ordered steps to the opening of the window that is open when each slice begins."""
    key, number, open_at, settled, started = None, None, NEVER, False, False
    for batch in batches:
        keys, slices, openings = [], [], []
        rows = zip(batch["k"], batch["slice"], batch["upto"], batch["last"])
        for k, s, upto, last in rows:
            if not started or k != key:
                key, number, open_at, started = k, None, NEVER, True
            if s != number:
                number, settled = s, False
                keys.append(k)
                slices.append(s)
                openings.append(open_at)
                end = open_at + window
            if not settled and upto > end:
                open_at, settled = last, True
        yield pd.DataFrame({"k": keys, "slice": slices, "open_at": openings})


def slice_openings(part: pd.DataFrame, window: int, length: int) -> pd.DataFrame:
    """The opening of the window each instant falls into, given the one open when its slice begins."""
    line = _Line(part, window, length)
    open_at = part["open_at"].to_numpy()
    still_open = line.us <= open_at + window
    front = line.first + np.add.reduceat(still_open, line.first)
    opens = np.zeros(len(part), dtype=bool)
    end = line.end
    while len(front):
        inside = front < end
        front, end = front[inside], end[inside]
        opens[front] = True
        front = line.follow[front]
    at_or_before = np.maximum.accumulate(np.where(opens, np.arange(len(part)), -1))
    opened = np.where(still_open, open_at, line.us[np.maximum(at_or_before, 0)])
    return pd.DataFrame({"k": part["k"], "us": part["us"], "n": part["n"], "opened": opened})
