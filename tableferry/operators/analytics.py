"""Views over runs, jobs, nodes and audit events."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.functions.status import (
    AUDIT_TARGET_OTHER,
    audit_severity,
    audit_text,
    job_action,
    job_severity,
    outcome,
)


class Span(NamedTuple):
    unit: str
    steps: int
    label: str


# Bucket unit, number of buckets and label format of each time range.
RANGES = {
    "5m": Span("minute", 5, "HH:mm"),
    "1h": Span("minute", 60, "HH:mm"),
    "24h": Span("hour", 24, "yyyy-MM-dd HH:00"),
    "7d": Span("day", 7, "yyyy-MM-dd"),
    "30d": Span("day", 30, "yyyy-MM-dd"),
    "3m": Span("day", 90, "yyyy-MM-dd"),
}


def run_outcomes(run_log: DataFrame, range: str, as_of: datetime) -> DataFrame:
    """Runs per time bucket and outcome, zero-filled: ``bucket, date, success, failed, running, total``.

    The buckets end with the one that holds ``as_of`` (UTC); exactly their time
    range is read, as a plain range on ``created_at`` that reaches the scan.
    Runs are aggregated first; the spine of at most 90 rows is then joined on.
    """
    span = RANGES.get(range, RANGES["7d"])
    spark = run_log.sparkSession
    step = F.expr(f"interval 1 {span.unit}")
    last = F.date_trunc(span.unit, F.lit(as_of).cast("timestamp")).cast("timestamp_ntz")
    first = last - F.expr(f"interval {span.steps - 1} {span.unit}")
    created = F.col("created_at").cast("timestamp_ntz")
    state = outcome(F.col("status"))
    counts = (
        run_log.filter((created >= first) & (created < last + step))
        .groupBy(F.date_trunc(span.unit, created).cast("timestamp_ntz").alias("bucket"))
        .agg(
            *[F.count_if(state == s).alias(s) for s in ("success", "failed", "running")],
            F.count(F.lit(1)).alias("total"),
        )
    )
    spine = spark.range(0, 1, 1, 1).select(F.explode(F.sequence(first, last, step)).alias("bucket"))
    # Both sides have at most one row per bucket: 90.
    return (
        spine.join(F.broadcast(counts), "bucket", "left")
        .select(
            "bucket",
            F.date_format("bucket", span.label).alias("date"),
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("success", "failed", "running", "total")],
        )
        .orderBy("bucket")
    )


def page(df: DataFrame, number: int = 1, size: int = 10, order: Column | None = None) -> DataFrame:
    """One page, newest id first. Numbers below 1 fall back to the first page and to ten rows."""
    number = number if number >= 1 else 1
    size = size if size >= 1 else 10
    return df.orderBy(order if order is not None else F.desc("id")).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, last_id: int | None, size: int = 10, id: str = "id") -> DataFrame:
    """The page that follows an id. Its cost does not grow with depth: a range on the id replaces the offset."""
    rest = df if last_id is None else df.filter(F.col(id) < last_id)
    return rest.orderBy(F.desc(id)).limit(size)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def jobs_with_network(jobs: DataFrame, networks: DataFrame, network_name: str | None = None) -> DataFrame:
    """Jobs of the networks with this name, or all jobs that have a network."""
    wanted = networks if network_name is None else networks.filter(F.col("network_name") == network_name)
    return jobs.join(wanted, "network_id")


def network_jobs(networks: DataFrame, jobs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Networks with their jobs and each job's schema; a network without jobs keeps one row."""
    return networks.join(jobs, "network_id", "left").join(schemas, "schema_id", "left")


def with_rules(schemas: DataFrame, rules: DataFrame) -> DataFrame:
    """Schemas with their rules, a row per rule and one for a schema without any.

    Flat rather than nested: however many rules a schema has, they stay rows.
    """
    return schemas.join(rules, "schema_id", "left")


def schema_creator(schemas: DataFrame, users: DataFrame) -> DataFrame:
    """Schemas with ``creator_name``; an unknown creator is ``System``."""
    names = users.select(F.col("user_id").alias("created_by"), F.col("username").alias("__name"))
    joined = schemas.join(names, "created_by", "left")
    return joined.withColumn("creator_name", F.coalesce("__name", F.lit("System"))).drop("__name")


def fleet_summary(nodes: DataFrame) -> DataFrame:
    """Nodes, online nodes and mean CPU (a missing value counts 0, no nodes give 0)."""
    return nodes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "online").alias("online"),
        F.coalesce(F.avg(F.coalesce("cpu_usage", F.lit(0.0))), F.lit(0.0)).alias("avg_cpu"),
    )


def console_totals(schemas: DataFrame, networks: DataFrame, jobs: DataFrame) -> DataFrame:
    """``schemas, networks, jobs, active_agents`` as one row, counted in one job."""
    names = ("schemas", "networks", "jobs", "active_agents")
    online = networks.filter(F.col("status") == "online")
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select([F.col("n") if c == name else F.lit(0) for c in names])
        for name, df in zip(names, (schemas, networks, jobs, online))
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).toDF(*names)
    return rows.agg(*[F.sum(c).cast("bigint").alias(c) for c in names])


def activity_feed(jobs: DataFrame, audit: DataFrame, n: int = 6) -> DataFrame:
    """Jobs that ran and audit events as one feed, the newest ``n``.

    ``jobs``: ``job_id, name, status, last_run``; ``audit``: ``id, action,
    entity, details, username, created_at``. Each side is cut to its own newest
    ``n`` before the union.
    """
    def newest(df: DataFrame) -> DataFrame:
        return df.orderBy(F.desc("happened_at"), "id").limit(n)

    ran = jobs.filter(F.year("last_run") > 2000).select(
        F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("id"),
        job_action(F.col("status")).alias("action"),
        F.col("name").alias("target"),
        F.col("last_run").alias("happened_at"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        job_severity(F.col("status")).alias("status_type"),
        F.lit("job").alias("type"),
    )

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    events = audit.select(
        F.concat(F.lit("log-"), F.col("id").cast("string")).alias("id"),
        audit_text(F.col("action"), F.col("entity")).alias("action"),
        F.coalesce(filled("details"), filled("username"), F.lit(AUDIT_TARGET_OTHER)).alias("target"),
        F.col("created_at").alias("happened_at"),
        F.lit("completed").alias("status"),
        audit_severity(F.col("action")).alias("status_type"),
        F.lit("log").alias("type"),
    )
    return newest(newest(ran).unionByName(newest(events)))


def first_rule_per_table(rules: DataFrame) -> DataFrame:
    """The rule with the least id for each target table."""
    rest = [c for c in rules.columns if c != "target_table"]
    best = rules.groupBy("target_table").agg(F.min_by(F.struct(*rest), "rule_id").alias("r"))
    return best.select("target_table", "r.*")


def batch_rules(batches: DataFrame, rules: DataFrame) -> DataFrame:
    """Batches with the first rule of their target table, if there is one."""
    return batches.join(first_rule_per_table(rules), "target_table", "left")


def sample_rows(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a fixed order, as JSON."""
    first = df.orderBy(*order_by).limit(n)
    return first.select(*order_by, F.to_json(F.struct("*")).alias("sample"))


def log_errors(logs: DataFrame, since: datetime, until: datetime) -> DataFrame:
    """How many errors a time window holds."""
    inside = (F.col("time") >= F.lit(since)) & (F.col("time") < F.lit(until))
    return logs.filter(inside & (F.col("level") == "error")).agg(F.count(F.lit(1)).alias("errors"))


def log_distinct_errors(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("level") == "error").select("message").distinct()


def log_containing(logs: DataFrame, word: str) -> DataFrame:
    return logs.filter(F.contains("message", F.lit(word))).select("time", "level", "message")


def node_state(heartbeats: DataFrame) -> DataFrame:
    """Last known state per node: latest report, and for each metric the latest that was sent.

    Order-free aggregates only: the same code serves tables and streams.
    """
    def latest(name: str, always: bool = False) -> Column:
        value = F.struct(F.col("ts"), F.col(name))
        picked = F.max(value if always else F.when(F.col(name).isNotNull(), value))
        return picked.getField(name).alias(name)

    metrics = ["cpu_usage", "memory_total", "memory_used", "memory_free", "version"]
    return heartbeats.groupBy("agent_name").agg(
        latest("status", always=True),
        F.max("ts").alias("last_seen"),
        latest("ip_address", always=True),
        *[latest(m) for m in metrics if m in heartbeats.columns],
    )


def node_metrics(heartbeats: DataFrame, width: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """Mean and greatest CPU per node and time window; on a stream give the allowed lateness."""
    source = heartbeats.withWatermark("ts", watermark) if watermark else heartbeats
    return (
        source.groupBy("agent_name", F.window("ts", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("reports"),
            F.avg("cpu_usage").alias("avg_cpu"),
            F.max("cpu_usage").alias("max_cpu"),
        )
        .select("agent_name", F.col("w.start").alias("window_start"), "reports", "avg_cpu", "max_cpu")
    )
