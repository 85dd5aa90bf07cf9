"""Comparison inside sorted groups of rows: groups are walked whole, long ones are cut into pairs of parts beforehand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A group that covers more than one row in this many, and more rows than ``LEAST``, is crowded: there are no more of them than that.
CROWDED_SHARE, LEAST = 1024, 256
BUCKETS = 4096


def crowded(rows: DataFrame, key: str) -> list[int]:
    """The crowded values of ``key``, a column of 64-bit hashes: only hashes in full buckets are counted by themselves."""
    bucket = F.pmod(F.col(key), F.lit(BUCKETS))
    counts = {r["bucket"]: r["count"] for r in rows.groupBy(bucket.alias("bucket")).count().collect()}
    most = max(LEAST, sum(counts.values()) // CROWDED_SHARE)
    full = [k for k, n in counts.items() if n > most]
    return [r[key] for r in rows.filter(bucket.isin(full)).groupBy(key).count().filter(F.col("count") > most).collect()] if full else []


def told_groups(rows: DataFrame, by: list[str], told: dict[str, Column], keep: str) -> DataFrame:
    """The rows of the groups that ``keep`` holds for, with the aggregates ``told`` of their groups.

    Rows are shuffled once, whatever their number: groups are read as windows. Those of a crowded value of the first column of
    ``by`` are not shuffled at all: their aggregates are combined in the tasks before they meet, and sent back to all.
    """
    many, own = crowded(rows, by[0]), Window.partitionBy(*by)
    few = rows.filter(~F.col(by[0]).isin(many)).select("*", *[c.over(own).alias(name) for name, c in told.items()]).filter(keep)
    if not many:
        return few
    rows = rows.filter(F.col(by[0]).isin(many))
    return few.unionByName(rows.join(F.broadcast(rows.groupBy(*by).agg(*[c.alias(name) for name, c in told.items()]).filter(keep)), by))


def in_parts(rows: DataFrame, key: str, parts: str, member: str, keep: list[str | Column]) -> DataFrame:
    """Give each row a ``block`` and a ``part``.

    A group of one part is one block, whose rows have part -1. A group of more parts has a block for each pair of its
    parts, so that each pair of its rows meets exactly once, and the work on one long group is spread over many tasks.
    """
    rows = rows.withColumn("__own", F.pmod(F.xxhash64(member), F.col(parts)).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    part = F.when(low == high, F.lit(-1)).otherwise(F.col("__own"))
    rows = rows.select(F.xxhash64(key, low, high).alias("block"), part.cast("int").alias("part"), *keep)
    return rows.repartition("block").sortWithinPartitions("block")


def whole_blocks(compared: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Call ``compared`` with tables of whole blocks; rows come sorted, and the last block of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            block = table.column("block").to_numpy()
            end = len(block) - int(np.argmax((block != block[-1])[::-1])) if len(block) and block[0] != block[-1] else 0
            rest = table.slice(end)
            if end:
                yield compared(table.slice(0, end))
        if rest is not None and rest.num_rows:
            yield compared(rest)

    return run


def pairs_in_blocks(block: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows to compare, whole columns at a time, at one distance after another."""
    left, distance = np.arange(len(block)), 1
    while len(left := left[left + distance < len(block)]):
        left = left[block[left] == block[left + distance]]
        right = left + distance
        met = (part[left] != part[right]) | (part[left] < 0)
        yield left[met], right[met]
        distance += 1
