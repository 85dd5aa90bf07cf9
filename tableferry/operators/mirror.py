"""Incremental copies of object trees."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.session import path_exists, qualified_path, scratch_dir
from tableferry.sources.files import list_objects, locate

# Content types by export format.
CONTENT_TYPES = {
    "csv": "text/csv",
    "json": "application/json",
    "parquet": "application/octet-stream",
    "jsonl": "application/x-ndjson",
}

COPY_CHUNK = 8 * 1024 * 1024
BYTES_PER_TASK = 1024**3
OBJECTS_PER_TASK = 2_000


def content_type(format: str) -> str:
    return CONTENT_TYPES.get(format.lower(), "application/octet-stream")


def mirror_plan(source: DataFrame, target: DataFrame, incremental: bool = True) -> DataFrame:
    """What to do with each source object: ``key, size, modified, action``.

    ``new`` if the target lacks it, ``size`` if the sizes differ, ``newer`` if
    the source was modified strictly later, else ``skip``; in that order.
    Objects only the target has are left alone. Keys are paths, so neither side
    repeats one.
    """
    if not incremental:
        return source.select("key", "size", "modified", F.lit("copy").alias("action"))
    have = target.select("key", F.col("size").alias("__size"), F.col("modified").alias("__modified"))
    action = (
        F.when(F.col("__size").isNull(), "new")
        .when(F.col("size") != F.col("__size"), "size")
        .when(F.col("modified") > F.col("__modified"), "newer")
        .otherwise("skip")
    )
    return source.join(have, "key", "left").select("key", "size", "modified", action.alias("action"))


def mirror(
    spark: SparkSession,
    source_root: str,
    target_root: str,
    pattern: str = "",
    prefix: str = "",
    incremental: bool = True,
    since=None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Copy what ``mirror_plan`` says and return one row per object: ``key, action, bytes, error``.

    The plan is written before the first copy and the outcome after the last, so
    a lost executor repeats copies but never sees a half-done tree as its input.
    An object that cannot be copied becomes an error row. ``since`` limits the
    pass to objects modified later; ``source`` gives their listing (``key, size, modified``) instead.
    """
    source_root, target_root = qualified_path(spark, source_root), qualified_path(spark, target_root)
    if source is None:
        source = list_objects(spark, source_root, prefix, pattern)
    if since is not None:
        source = source.filter(F.col("modified") > F.lit(since))
    if path_exists(spark, target_root):
        target = list_objects(spark, target_root, prefix)
    else:
        target = spark.createDataFrame([], source.schema)
    plan_path = scratch_dir(spark, "mirror-plan")
    mirror_plan(source, target, incremental).write.parquet(plan_path)
    plan = spark.read.parquet(plan_path)

    todo = plan.filter(F.col("action") != "skip")
    size = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # A fixed number of partitions: the rows are tiny, so adaptive execution would put all copies in one task.
    tasks = max(1, min(size[0], max(size[0] // OBJECTS_PER_TASK, size[1] // BYTES_PER_TASK, _cores(spark))))

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, errors = [], []
            for key in batch["key"]:
                try:
                    done.append(copy_object(f"{source_root.rstrip('/')}/{key}", f"{target_root.rstrip('/')}/{key}"))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - reported per object, the pass goes on
                    done.append(0)
                    errors.append(f"{key}: {error}")
            yield pd.DataFrame({"key": batch["key"], "action": batch["action"], "bytes": done, "error": errors})

    result_path = scratch_dir(spark, "mirror-result")
    copied = todo.select("key", "action").repartition(tasks).mapInPandas(
        copy, "key string, action string, bytes bigint, error string"
    )
    copied.write.parquet(result_path)
    skipped = plan.filter(F.col("action") == "skip").select(
        "key", "action", F.lit(0).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("error")
    )
    return spark.read.schema(copied.schema).parquet(result_path).unionByName(skipped)


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def copy_object(source: str, target: str) -> int:
    """Stream one object to a private name and rename it, so a repeated or cut-off copy leaves no half object."""
    source_fs, source_path = locate(source)
    target_fs, target_path = locate(target)
    folder, name = os.path.split(target_path)
    target_fs.create_dir(folder, recursive=True)
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else os.getpid()
    partial = f"{folder}/_{name}.{attempt}.partial"
    size = 0
    with source_fs.open_input_stream(source_path) as reader, target_fs.open_output_stream(partial) as writer:
        while chunk := reader.read(COPY_CHUNK):
            writer.write(chunk)
            size += len(chunk)
    target_fs.move(partial, target_path)
    return size


def mirror_stats(result: DataFrame) -> DataFrame:
    """Objects copied and skipped, bytes, and how many failed."""
    failed = F.col("error").isNotNull()
    skipped = F.col("action") == "skip"
    return result.agg(
        F.count_if(~failed & ~skipped).alias("objects_copied"),
        F.count_if(skipped).alias("objects_skipped"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes_copied"),
        F.count_if(failed).alias("errors"),
    )


def mirror_errors(result: DataFrame) -> DataFrame:
    """One row per failed object; kept as rows, since there may be very many."""
    return result.filter(F.col("error").isNotNull()).select("key", "error")
