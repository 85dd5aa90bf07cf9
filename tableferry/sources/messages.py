"""The message log: one message per line, plain, packed (``GZ:``) or encrypted (``ENC:``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.functions.protect import decrypt, unpack


def read_message_log(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Raw lines of landed message files; a stream picks up new files."""
    if streaming:
        return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return spark.read.text(path)


def parse_messages(lines: DataFrame, key: bytes | None = None, column: str = "value") -> DataFrame:
    """Messages as ``type, agent_name, status, timestamp, data`` plus ``raw`` and ``bad``.

    A line that cannot be opened, unpacked or read as a JSON object is ``bad``;
    split it off with ``bad_messages``, or skip it with ``good_messages``.
    """
    raw = F.col(column)
    clear = decrypt(raw, key) if key is not None else F.when(~raw.startswith("ENC:"), raw)
    # Each step is the one row of an array: the optimiser moves no filter on its result before it, which would open,
    # unpack and parse every line twice.
    opened = lines.filter(F.trim(raw) != "").select(raw.alias("raw"), F.inline(F.array(F.struct(clear.alias("clear")))))
    unpacked = opened.select("raw", unpack(F.col("clear")).alias("text"))
    body = unpacked.select("raw", F.inline(F.array(F.struct(F.try_parse_json("text").alias("message")))))
    message = F.col("message")

    def text_field(name: str):
        return F.try_variant_get(message, f"$.{name}", "string")

    return body.select(
        "raw",
        text_field("type").alias("type"),
        text_field("agent_name").alias("agent_name"),
        text_field("status").alias("status"),
        text_field("timestamp").try_cast("timestamp").alias("timestamp"),
        F.try_variant_get(message, "$.data", "variant").alias("data"),
        (message.isNull() | ~F.startswith(F.coalesce(F.schema_of_variant(message), F.lit("")), F.lit("OBJECT"))).alias("bad"),
    )


def good_messages(messages: DataFrame, type: str | None = None) -> DataFrame:
    good = messages.filter(~F.col("bad")).drop("raw", "bad")
    return good.filter(F.col("type") == type) if type else good


def bad_messages(messages: DataFrame) -> DataFrame:
    return messages.filter("bad").select("raw")


def heartbeats(messages: DataFrame) -> DataFrame:
    """Node reports: ``agent_name, ts, status, ip_address, cpu_usage, memory_*, version``."""
    data = F.col("data")

    def number(name: str, type: str):
        return F.try_variant_get(data, f"$.{name}", "double").cast(type).alias(name)

    return good_messages(messages, "HEARTBEAT").select(
        "agent_name",
        F.col("timestamp").alias("ts"),
        "status",
        F.try_variant_get(data, "$.ip_address", "string").alias("ip_address"),
        number("cpu_usage", "double"),
        number("memory_total", "bigint"),
        number("memory_used", "bigint"),
        number("memory_free", "bigint"),
        F.try_variant_get(data, "$.version", "string").alias("version"),
    )


def run_batches(messages: DataFrame) -> DataFrame:
    """Batch reports of runs, in the shape ``fold_runs`` takes."""
    data = F.col("data")
    error = F.coalesce(F.try_variant_get(data, "$.error", "string"), F.lit(""))
    return good_messages(messages, "DATA_RESPONSE").select(
        F.try_variant_get(data, "$.job_id", "bigint").alias("job_id"),
        F.try_variant_get(data, "$.log_id", "bigint").alias("log_id"),
        F.col("timestamp").alias("ts"),
        F.coalesce(F.try_variant_get(data, "$.status", "string"), F.lit("completed")).alias("status"),
        F.coalesce(F.try_variant_get(data, "$.record_count", "bigint"), F.lit(0)).alias("record_count"),
        error.alias("error"),
        F.coalesce(F.try_variant_get(data, "$.partial", "boolean"), F.lit(False)).alias("partial"),
        F.to_json(F.try_variant_get(data, "$.records", "variant")).alias("sample"),
    )
