"""Run a sync: extract, merge, account, advance the checkpoint."""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tableferry.functions.names import validate_columns
from tableferry.operators.keys import next_key
from tableferry.operators.merge import ACTION, insert_skip, upsert
from tableferry.operators.mirror import mirror, mirror_stats
from tableferry.operators.runs import next_checkpoint
from tableferry.operators.tables import BucketedTable, VersionedTable
from tableferry.plans.hooks import run_hooks, sql_executor
from tableferry.session import delete_folder, path_exists, scratch_dir
from tableferry.sources import documents, files, keyspace, responses
from tableferry.sources.jdbc import bind_checkpoint, read_query, read_ranges
from tableferry.sources.sql import incremental_extract
from tableferry.spec import Rule, SyncSpec

log = logging.getLogger("tableferry")

EVENTS = (
    "run string, rule string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, duration_ms bigint, "
    "record_count bigint, inserted bigint, updated bigint, checkpoint string, checkpoint_type string, next_key bigint, "
    "extract_ms bigint, load_ms bigint, error string"
)


def extract(spark: SparkSession, spec: SyncSpec, rule: Rule, checkpoint: Any = None) -> DataFrame:
    """A rule's rows, lazily, by the kind of its source.

    In the lake the checkpoint is bound; at a database it is a literal of its type. ``options`` of a file source may name
    ``format``, ``header``, ``sep`` and ``pick``: ``first``, the first file that matches, or ``all``, for a table that lies in
    many files; those of documents and responses the column that holds them.
    """
    kind, options = spec.source.kind, dict(spec.source.options)
    if kind == "database":
        if spec.source.format == "jdbc":
            url = options.pop("url")
            query = bind_checkpoint(rule.source_query, checkpoint)
            if rule.range_column:
                lower, upper, parts = rule.ranges
                return read_ranges(spark, url, query, rule.range_column, lower, upper, parts, options)
            return read_query(spark, url, query, options)
        if rule.source_query:
            return incremental_extract(spark, rule.source_query, checkpoint)
        return spark.read.format(spec.source.format).options(**options).load(spec.source.path)
    if kind == "file":
        header = options.get("header", "true").lower() == "true"
        path = spec.source.path
        if rule.source_query:
            found = files.select_files(spark, path, rule.source_query, pick=options.get("pick", "first"))
            path = sorted(r[0] for r in found.select("path").collect())
        return files.read_file(spark, path, options.get("format"), header, options.get("sep", ","))
    landed = spark.read.format(spec.source.format).load(spec.source.path)
    if kind == "api":
        return responses.response_records(landed, rule.schema)
    if kind == "mongodb":
        return documents.find(landed, json.loads(rule.source_query or "{}"))
    if kind == "redis":
        return keyspace.scan_keys(landed, rule.source_query or "*")
    raise ValueError(f"a {kind} source has no rows of its own: use run_transform")


def run(spark: SparkSession, spec: SyncSpec, state: str, as_of: datetime, checkpoints: Mapping[str, Any] | None = None) -> DataFrame:
    """Run every rule in order and return one event row per rule.

    ``state`` is the folder of the run log. ``checkpoints`` holds the last value
    per target table; without them they are those of the run log, so that a run goes on where the one before ended. The
    extraction is written once to the shared folder, so the write, the counts and the new
    checkpoint all see the same rows. The new checkpoint is known before the
    target is written, and counts only after that has committed. A run that is repeated with the same ``as_of`` merges
    nothing twice.
    """
    spec.validate()
    if checkpoints is None:
        checkpoints = typed_checkpoints(spark, state)
    rows = []
    for rule in spec.rules:
        started = time.monotonic()
        stored = checkpoints.get(rule.target_table)
        event: dict[str, Any] = {"checkpoint": stored, "checkpoint_type": type_name(stored), "status": "completed"}
        try:
            event.update(_run_rule(spark, spec, rule, stored, as_of))
        except Exception as error:  # noqa: BLE001 - recorded; later rules still run
            log.exception("rule %s failed", rule.target_table)
            event.update(status="failed", error=str(error))
        ms = int((time.monotonic() - started) * 1000)
        shown = None if event["checkpoint"] is None else str(event["checkpoint"])
        counts = [event.get(c, 0) for c in ("record_count", "inserted", "updated")]
        rows.append(
            (f"{spec.name}@{as_of.isoformat()}", rule.target_table, event["status"], as_of, as_of + timedelta(milliseconds=ms), ms)
            + (*counts, shown, event["checkpoint_type"], *[event.get(c) for c in ("next_key", "extract_ms", "load_ms", "error")])
        )
    events = spark.createDataFrame(rows, EVENTS)
    events.coalesce(1).write.mode("append").parquet(state)
    return events


def _run_rule(spark: SparkSession, spec: SyncSpec, rule: Rule, stored: Any, as_of: datetime) -> dict[str, Any]:
    if spec.source.kind == "minio":
        return _mirrored(spark, spec, rule)
    at_source = sql_executor(spark, spec.source)
    at_target = sql_executor(spark, spec.target)
    run_hooks(at_target, [rule.upload_pre], spec.hook_errors)
    run_hooks(at_source, [rule.extract_pre], spec.hook_errors)
    path = scratch_dir(spark, "extract")
    began = time.monotonic()
    try:
        validate_columns(extract(spark, spec, rule, stored)).write.parquet(path)
        rows = spark.read.parquet(path)
        extracted = time.monotonic()
        run_hooks(at_source, [rule.extract_post], spec.hook_errors)
        out: dict[str, Any] = {"record_count": rows.count()}
        column = spec.checkpoint_column
        if column and column in rows.columns:
            # Before the load: a checkpoint that cannot be compared must not surface when the target has changed.
            out |= {"checkpoint": next_checkpoint(rows, column, stored), "checkpoint_type": rows.schema[column].dataType.simpleString()}
        loading = time.monotonic()
        out |= _load(spark, spec, rule, rows, f"{spec.name}@{as_of.isoformat()}".replace(":", "."))
        out |= {"extract_ms": int((extracted - began) * 1000), "load_ms": int((time.monotonic() - loading) * 1000)}
    finally:
        delete_folder(spark, path)
    run_hooks(at_target, [rule.upload_post], spec.hook_errors)
    return out


def _mirrored(spark: SparkSession, spec: SyncSpec, rule: Rule) -> dict[str, Any]:
    """A rule of a bucket source copies objects; the copies count as rows, and one that fails makes the run fail."""
    began = time.monotonic()
    target = f"{spec.target.path.rstrip('/')}/{rule.target_table}"
    stats = mirror_stats(mirror(spark, spec.source.path, target, pattern=rule.source_query)).first()
    if stats["errors"]:
        raise RuntimeError(f"{stats['errors']} of {stats['errors'] + stats['objects_copied']} objects could not be copied")
    copied = stats["objects_copied"]
    return {"record_count": copied, "inserted": copied, "load_ms": int((time.monotonic() - began) * 1000)}


def _load(spark: SparkSession, spec: SyncSpec, rule: Rule, rows: DataFrame, tag: str) -> dict[str, Any]:
    if spec.target.format == "jdbc":
        from tableferry.operators import jdbc_sink

        options = dict(spec.target.options)
        url, dialect = options.pop("url"), options.pop("dialect", "postgres")
        if rule.truncate:
            jdbc_sink.jdbc_truncate_load(rows, url, rule.target_table, options, dialect)
        elif rule.key:
            jdbc_sink.jdbc_merge(rows, url, rule.target_table, rule.key, rule.order_by, dialect, options)
        else:
            jdbc_sink.jdbc_append(rows, url, rule.target_table, options, dialect)
        return {}
    path = f"{spec.target.path.rstrip('/')}/{rule.target_table}"
    # Letters, digits and dashes, no number at the end: a repeated run is told by its whole name.
    tag = re.sub(r"[^A-Za-z0-9_.-]", "-", tag) + "-run"
    if rule.buckets and rule.key and not rule.truncate:
        table: VersionedTable | BucketedTable = BucketedTable(spark, path, rule.key, rule.buckets)
        table.upsert(rows, rule.order_by, tag)
        counts: dict[str, Any] = {}
    else:
        table = VersionedTable(spark, path)
        counts = _new_version(spark, table, rule, rows, tag)
    if rule.key and isinstance(rows.schema[rule.key].dataType, IntegralType):
        free = next_key(spark, {rule.target_table: (table.read(), rule.key)}).first()
        counts["next_key"] = free["next_key"]
    return counts


def _new_version(spark: SparkSession, table: VersionedTable, rule: Rule, rows: DataFrame, tag: str) -> dict[str, Any]:
    if table.has_tag(tag):
        return {}
    current = None if rule.truncate else table.read()
    unique = rule.key if rule.key and (current is None or table.holds_once(rule.key)) else None
    if current is None:
        # The table is there before its rows are, with the types of the first extract.
        current = spark.createDataFrame([], rows.schema)
    if rule.key:
        merged = upsert(current, rows, rule.key, rule.order_by, target_unique=unique is not None, with_action=True)
    else:
        merged = insert_skip(current, rows, with_action=True)
    seen = Observation()
    inserted = F.count_if(F.col(ACTION) == "inserted").alias("inserted")
    updated = F.count_if(F.col(ACTION) == "updated").alias("updated")
    table.commit(merged.observe(seen, inserted, updated).drop(ACTION), tag, unique)
    return dict(seen.get)


def type_name(value: Any) -> str | None:
    """The Spark type that a checkpoint kept as text is read back as."""
    names = {bool: "boolean", int: "bigint", float: "double", Decimal: "decimal(38,18)", datetime: "timestamp_ntz", date: "date"}
    return None if value is None else names.get(type(value), "string")


def typed_checkpoints(spark: SparkSession, state: str) -> dict[str, Any]:
    """The greatest checkpoint of each rule in the run log, as a value of its own type: one per rule."""
    stored = last_checkpoints(spark, state)
    found: dict[str, Any] = {}
    for kind in [r[0] for r in stored.select("checkpoint_type").distinct().collect()]:
        typed = stored.filter(F.col("checkpoint_type") == kind).select("rule", F.col("checkpoint").cast(kind).alias("value"))
        found |= {r["rule"]: r["value"] for r in typed.collect()}
    return found


def last_checkpoints(spark: SparkSession, state: str) -> DataFrame:
    """``rule, checkpoint, checkpoint_type``: the greatest checkpoint of each rule by its newest type, as text."""
    if not path_exists(spark, state):
        return spark.createDataFrame([], "rule string, checkpoint string, checkpoint_type string")
    done = spark.read.parquet(state).filter((F.col("status") == "completed") & F.col("checkpoint").isNotNull())
    newest = done.groupBy("rule").agg(F.max_by("checkpoint_type", "completed_at").alias("checkpoint_type"))
    done = done.join(newest, ["rule", "checkpoint_type"])
    parts = []
    for kind in [r[0] for r in newest.select("checkpoint_type").distinct().collect()]:
        own = done.filter(F.col("checkpoint_type") == kind).groupBy("rule", "checkpoint_type")
        parts.append(own.agg(F.max_by("checkpoint", F.col("checkpoint").cast(kind)).alias("checkpoint")).select("rule", "checkpoint", "checkpoint_type"))
    if not parts:
        return spark.createDataFrame([], "rule string, checkpoint string, checkpoint_type string")
    return reduce(DataFrame.unionByName, parts)


def bulk_sync(
    spark: SparkSession, tables: Mapping[str, DataFrame], target_root: str, prefix: str = "", parallel: int = 4
) -> DataFrame:
    """Copy many tables and report ``(table_name, status, row_count, error)``; one failure does not stop the rest.

    Tables are submitted from a few threads, so small ones share the cluster
    with large ones. Rows are counted by the write itself.
    """
    def one(item: tuple[str, DataFrame]) -> tuple[str, str, int, str | None]:
        name, df = item
        try:
            seen = Observation()
            counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
            counted.write.mode("overwrite").parquet(f"{target_root.rstrip('/')}/{prefix}{name}")
            return f"{prefix}{name}", "completed", seen.get["n"], None
        except Exception as error:  # noqa: BLE001 - collected per table
            return f"{prefix}{name}", "failed", 0, str(error)

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(one, sorted(tables.items())))
    return spark.createDataFrame(rows, "table_name string, status string, row_count bigint, error string")
