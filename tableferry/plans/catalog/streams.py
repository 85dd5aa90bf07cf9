"""Streams over the given tables; each must end where the batch form ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.operators.analytics import node_metrics
from tableferry.operators.runs import runs_of
from tableferry.operators.tables import BucketedTable, VersionedTable
from tableferry.plans.catalog.merging import MERGED, ORDER
from tableferry.plans.catalog.registry import ORACLES, ROLES, query, role, table
from tableferry.plans.catalog.runlog import FOLDED
from tableferry.session import scratch_dir
from tableferry.streaming.throttle import stream_throttle
from tableferry.streaming.upsert import stream_node_state, stream_run_status, stream_upsert


def role_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A one-table role over the stream of that table's files."""
    (source,), sql = ROLES[name]
    schema = table(spark, sf, source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{source}.parquet").parquet(sf)
    stream.createOrReplaceTempView(source)
    return spark.sql(sql)


@query("stream_upsert", MERGED)
def upserted(spark, sf):
    orders = VersionedTable(spark, scratch_dir(spark, "orders"))
    orders.commit(role(spark, sf, "orders_target"))
    feed = role_stream(spark, sf, "orders_feed")
    stream_upsert(feed, orders, "o_orderkey", ORDER, scratch_dir(spark, "progress")).awaitTermination()
    return orders.read()


@query("stream_upsert_bucketed", MERGED)
def upserted_buckets(spark, sf):
    orders = BucketedTable(spark, scratch_dir(spark, "orders"), "o_orderkey", buckets=16)
    orders.create(role(spark, sf, "orders_target"))
    feed = role_stream(spark, sf, "orders_feed")
    stream_upsert(feed, orders, "o_orderkey", ORDER, scratch_dir(spark, "progress")).awaitTermination()
    return orders.read()


@query("stream_run_status", FOLDED)
def run_status(spark, sf):
    log = VersionedTable(spark, scratch_dir(spark, "runs"))
    stream_run_status(role_stream(spark, sf, "batches"), log, scratch_dir(spark, "progress")).awaitTermination()
    return runs_of(log.read())


@query("stream_node_state", ORACLES["node_state"])
def node_states(spark, sf):
    nodes = VersionedTable(spark, scratch_dir(spark, "nodes"))
    stream_node_state(role_stream(spark, sf, "heartbeats"), nodes, scratch_dir(spark, "progress")).awaitTermination()
    return nodes.read()


def _landed(stream: DataFrame, mode: str, spark: SparkSession, columns: str) -> DataFrame:
    """Run a stream over what is there into a table, and read it."""
    path = scratch_dir(spark, "landed")
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
    writer.option("checkpointLocation", scratch_dir(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(columns).parquet(path)


@query("stream_throttle", ORACLES["throttle_events"])
def throttled(spark, sf):
    events = spark.readStream.schema(table(spark, sf, "events").schema)
    events = events.option("pathGlobFilter", "events.parquet").parquet(sf)
    judged = stream_throttle(events.select("event_id", "user_id", "ts"), "user_id", "ts", 3, 12 * 3600)
    return _landed(judged, "append", spark, "event_id bigint, user_id bigint, ts timestamp_ntz, allowed boolean")


@query(
    "stream_node_metrics",
    """with w as (select concat('node', user_id) as agent_name, time_bucket(interval 1 day, ts) as window_start,
      count(*) as reports from events group by 1, 2)
    select * from w where window_start + interval 1 day <= (select max(ts) - interval 1 hour from events)""",
)
def node_metrics_stream(spark, sf):
    """Windows that the watermark has closed."""
    beats = role_stream(spark, sf, "heartbeats").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = node_metrics(beats, "1 day", "1 hour")
    columns = "agent_name string, window_start timestamp, reports bigint, avg_cpu double, max_cpu double"
    rows = _landed(closed, "append", spark, columns)
    return rows.select("agent_name", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "reports")
