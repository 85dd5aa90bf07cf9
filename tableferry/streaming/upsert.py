"""Micro-batch upsert, run states and node states from streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tableferry.operators.analytics import node_state
from tableferry.operators.runs import add_parts, run_parts
from tableferry.operators.tables import BucketedTable, VersionedTable
from tableferry.session import scratch_dir

Table = VersionedTable | BucketedTable
# Versions that a stream leaves behind: the current one, and those that a reader may still have open.
KEPT_VERSIONS = 5


def upsert_batches(table: Table, name: str, key: str, order_by: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function; a batch that is repeated after a restart adds nothing, not even
    rows without a key.

    A versioned table suits small targets, since every batch writes it anew; a
    bucketed one rewrites only the buckets a batch hits.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tag = f"{name}-{batch_id}"
        if isinstance(table, BucketedTable):
            table.upsert(batch, order_by, tag)
        elif not table.has_tag(tag):
            table.upsert(batch, key, order_by, tag)
        table.expire(KEPT_VERSIONS)

    return write


def stream_upsert(
    stream: DataFrame,
    table: Table,
    key: str,
    order_by: Sequence[str],
    checkpoint: str,
    name: str = "upsert",
    **trigger,
) -> StreamingQuery:
    """Merge every micro-batch of a stream into a table."""
    writer = stream.writeStream.outputMode("append").foreachBatch(upsert_batches(table, name, key, order_by))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_run_status(
    batches: DataFrame, table: Table, checkpoint: str, name: str = "runs", **trigger
) -> StreamingQuery:
    """Keep the run log up to date from a stream of batch reports; ``runs_of(table.read())`` is the log.

    Each micro-batch is folded by itself and added to the rows of the same runs in the table, which holds what adds up.
    So the stream keeps no state at all, however many runs there ever were; a report that comes long after its run has
    ended still counts, and a batch that is repeated after a restart adds nothing.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        tag = f"{name}-{batch_id}"
        if table.has_tag(tag):
            return
        spark, path = batch.sparkSession, scratch_dir(batch.sparkSession, "run-parts")
        run_parts(batch.filter("log_id is not null")).write.parquet(path)
        news = spark.read.parquet(path)
        held = table.read() if is_filled(table) else None
        if held is not None:
            news = add_parts(news.unionByName(held.join(news.select("log_id"), "log_id", "left_semi").select(*news.columns)))
        if isinstance(table, BucketedTable):
            table.upsert(news, [], tag)
        else:
            table.upsert(news, "log_id", [], tag)
        table.expire(KEPT_VERSIONS)

    writer = batches.writeStream.outputMode("append").foreachBatch(add)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def is_filled(table: Table) -> bool:
    return table.manifest() is not None if isinstance(table, BucketedTable) else bool(table.versions())


def stream_node_state(
    heartbeats: DataFrame, table: Table, checkpoint: str, name: str = "nodes", **trigger
) -> StreamingQuery:
    """Keep the last known state per node up to date from a stream of reports."""
    return _changed_rows(node_state(heartbeats), table, "agent_name", checkpoint, name, trigger)


def _changed_rows(
    folded: DataFrame, table: Table, key: str, checkpoint: str, name: str, trigger: dict
) -> StreamingQuery:
    writer = folded.writeStream.outputMode("update").foreachBatch(upsert_batches(table, name, key, []))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
