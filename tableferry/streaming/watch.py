"""Watch an object tree and keep a mirror of it up to date."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableferry.operators.mirror import mirror
from tableferry.session import delete_folder, path_exists, qualified_path, write_text
from tableferry.sources.files import list_objects
from tableferry.streaming.source import ObjectSource

# How often the tree is looked at.
POLL = "30 seconds"

RESOLUTION = timedelta(seconds=1)


class Watch:
    """Mirror passes that remember the newest modification they have seen.

    The first pass takes everything; later ones look at objects modified since.
    The mark is taken from the objects' own times, so a clock that differs from
    the store's loses nothing.
    """

    def __init__(self, spark: SparkSession, source_root: str, target_root: str, pattern: str = "", prefix: str = ""):
        self.spark = spark
        self.roots = (source_root, target_root)
        self.filters = (pattern, prefix)
        self.since: datetime | None = None

    def poll(self, on_event: Callable[[str, int], None] | None = None) -> DataFrame:
        listed = list_objects(self.spark, self.roots[0], self.filters[1], self.filters[0])
        newest = listed.agg(F.max("modified")).first()[0]
        result = mirror(self.spark, *self.roots, *self.filters, incremental=True, since=self.since)
        if on_event:
            on_event("initial_sync_complete" if self.since is None else "sync_complete", result.count())
        # What could not be copied is looked at again: the mark stays below the oldest failure. An object may
        # still be written within the same instant, so it stays just below the newest, too.
        failed = result.filter("error is not null").select("key")
        oldest = listed.join(failed, "key", "left_semi").agg(F.min("modified")).first()[0]
        marks = [m for m in (newest, oldest) if m]
        self.since = min(marks) - RESOLUTION if marks else self.since
        return result


def watch_and_mirror(
    spark: SparkSession,
    source_root: str,
    target_root: str,
    checkpoint: str,
    pattern: str = "",
    prefix: str = "",
    on_event: Callable[[str, int], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Copy what changes until the returned query is stopped; every 30 seconds unless a trigger is given.

    The changes are a stream whose mark lies in ``checkpoint``: a watch that is started again copies only what changed since
    it was stopped, and looks at each source object once a pass. Objects that could not be copied are noted by batch
    beside the mark and tried again with the next pass.
    """
    spark.dataSource.register(ObjectSource)
    notes = f"{checkpoint.rstrip('/')}/not-copied"
    mark = f"{notes}/again"
    options = {"root": qualified_path(spark, source_root), "prefix": prefix, "pattern": pattern, "again": qualified_path(spark, mark)}

    def copy(batch: DataFrame, batch_id: int) -> None:
        changed, before = batch.dropDuplicates(["key"]), f"{notes}/batch-{batch_id - 1}"
        if path_exists(spark, before):
            held = list_objects(spark, source_root, prefix, pattern).join(spark.read.parquet(before), "key", "left_semi")
            changed = changed.unionByName(held.select(*changed.columns)).dropDuplicates(["key"])
        result = mirror(spark, source_root, target_root, prefix=prefix, source=changed)
        failed = result.filter("error is not null").select("key")
        if failed.isEmpty():
            if path_exists(spark, mark):
                delete_folder(spark, mark)
        else:
            failed.write.mode("overwrite").parquet(f"{notes}/batch-{batch_id}")
            if not path_exists(spark, mark):
                write_text(spark, mark, "some objects could not be copied")
        if on_event:
            on_event("sync_complete" if batch_id else "initial_sync_complete", result.filter("action <> 'skip'").count())

    stream = spark.readStream.format("objects").options(**options).load()
    writer = stream.writeStream.foreachBatch(copy).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": POLL})).start()
