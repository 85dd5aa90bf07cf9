"""The run log: folding batch reports, checkpoints, repairs, latest runs, throughput."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.functions.names import quoted
from tableferry.operators.dedupe import latest_n_per_key, one_per_key

# Reasons written to the log.
STALE_REASON = "Job was marked as failed (possible agent disconnect)"
ABORT_REASON = "Aborted by user"


def run_parts(batches: DataFrame) -> DataFrame:
    """What the batch reports of each run say so far, in a form that adds up: one row per run.

    ``batches``: ``log_id, ts, status, record_count, error, partial, sample`` and optionally ``started_at``. A heavy run
    shrinks before the shuffle.
    """
    started = F.col("started_at") if "started_at" in batches.columns else F.col("ts")
    final = ~F.col("partial")
    has_error = F.coalesce(F.col("error"), F.lit("")) != ""
    has_sample = F.coalesce(F.col("sample"), F.lit("")) != ""

    def latest(value: str, when: Column) -> Column:
        # Text ends a tie in time, so the pick never depends on arrival.
        return F.max(F.when(when, F.struct(F.col("ts"), F.col(value).alias("value"))))

    return batches.groupBy("log_id").agg(
        F.sum("record_count").cast("bigint").alias("record_count"),
        F.bool_or(has_error | (F.col("status") == "failed")).alias("any_failed"),
        latest("status", final).alias("last_final"),
        F.min(started).alias("started_at"),
        latest("sample", has_sample).alias("last_sample"),
        latest("error", has_error).alias("last_error"),
    )


def add_parts(parts: DataFrame) -> DataFrame:
    """Several parts of a run as one, in any order."""
    return parts.groupBy("log_id").agg(
        F.sum("record_count").alias("record_count"),
        F.bool_or("any_failed").alias("any_failed"),
        F.max("last_final").alias("last_final"),
        F.min("started_at").alias("started_at"),
        F.max("last_sample").alias("last_sample"),
        F.max("last_error").alias("last_error"),
    )


def runs_of(parts: DataFrame) -> DataFrame:
    """The run log that the parts amount to."""
    completed = F.col("last_final.ts")
    micros = F.unix_micros(completed.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return parts.select(
        "log_id",
        F.when(F.col("any_failed"), "failed").otherwise(F.coalesce("last_final.value", F.lit("running"))).alias("status"),
        "record_count",
        "started_at",
        completed.alias("completed_at"),
        F.floor(micros / 1000).cast("bigint").alias("duration_ms"),
        F.col("last_sample.value").alias("sample_data"),
        F.col("last_error.value").alias("error_message"),
    )


def fold_runs(batches: DataFrame) -> DataFrame:
    """One row per run from its batch reports, whatever order they arrive in.

    Counts add up; an error or a failed report makes the run failed for good; else the latest final report decides; without
    one it is running. Only order-free aggregates are used, so a table and any cut of a stream fold alike.
    """
    return runs_of(run_parts(batches))


def checkpoint_max(df: DataFrame, column: str, mode: str = "typed") -> DataFrame:
    """The greatest non-NULL value of the checkpoint column, as one row.

    ``typed`` compares values of the column's type; ``lexicographic`` compares text.
    """
    if mode not in ("typed", "lexicographic"):
        raise ValueError("mode is 'typed' or 'lexicographic'")
    value = quoted(column) if mode == "typed" else quoted(column).cast("string")
    return df.agg(F.max(value).alias("checkpoint"))


def next_checkpoint(df: DataFrame, column: str, stored: Any = None, mode: str = "typed") -> Any:
    """The checkpoint after a run: it never moves back, and without rows it stays."""
    new = checkpoint_max(df, column, mode).first()[0]
    if mode == "lexicographic" and stored is not None:
        stored = str(stored)
    if new is None or stored is None:
        return stored if new is None else new
    return max(stored, new)


def repair_stale(run_log: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Runs still open under a failed job become failed, with the reason and the time.

    ``run_log``: ``log_id, job_id, status, error_message, completed_at, ...``;
    ``jobs``: ``job_id, status``. A left join, which adaptive execution can
    broadcast, or split at a job that has very many runs.
    """
    failed = jobs.filter(F.col("status") == "failed").select("job_id", F.lit(True).alias("__failed")).distinct()
    joined = run_log.join(failed, "job_id", "left")
    stale = F.col("__failed").isNotNull() & (F.col("status") == "running")
    out = {
        "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")),
        "error_message": F.when(stale, F.lit(STALE_REASON)).otherwise(F.col("error_message")),
        "completed_at": F.when(stale, as_of).otherwise(F.col("completed_at")),
    }
    return joined.select([out[c].alias(c) if c in out else F.col(c) for c in run_log.columns])


def latest_runs(run_log: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` runs of every job."""
    return latest_n_per_key(run_log, "job_id", [F.desc("created_at"), F.desc("log_id")], n)


def recent_runs(run_log: DataFrame, jobs: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` runs over all jobs, each with its job. The limit comes before the join."""
    newest = run_log.orderBy(F.desc("created_at"), F.desc("log_id")).limit(n)
    return newest.join(jobs, "job_id", "left")


def latest_running(run_log: DataFrame) -> DataFrame:
    """The newest open run of each job."""
    return one_per_key(run_log.filter(F.col("status") == "running"), "job_id", ["created_at"])


def abort_run(run_log: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """The newest open run of every aborted job (``jobs``: ``job_id``) becomes failed."""
    newest = latest_running(run_log.join(jobs.select("job_id").distinct(), "job_id", "left_semi"))
    marked = run_log.join(newest.select("log_id", F.lit(True).alias("__aborted")), "log_id", "left")
    hit = F.col("__aborted").isNotNull()
    out = {
        "status": F.when(hit, F.lit("failed")).otherwise(F.col("status")),
        "error_message": F.when(hit, F.lit(ABORT_REASON)).otherwise(F.col("error_message")),
        "completed_at": F.when(hit, as_of).otherwise(F.col("completed_at")),
    }
    return marked.select([out[c].alias(c) if c in out else F.col(c) for c in run_log.columns])


def drop_aborted(work: DataFrame, aborted: DataFrame) -> DataFrame:
    """Work of aborted jobs is left out."""
    return work.join(aborted.select("job_id").distinct(), "job_id", "left_anti")


def run_metrics(runs: DataFrame) -> DataFrame:
    """Rows per second of each run; a run shorter than a millisecond counts as one."""
    ms = F.greatest(F.coalesce(F.col("duration_ms"), F.lit(0)), F.lit(1))
    return runs.select(
        "log_id",
        "record_count",
        "started_at",
        "completed_at",
        "duration_ms",
        F.when(F.col("completed_at").isNotNull(), F.col("record_count") * 1000 / ms).alias("rows_per_second"),
    )
