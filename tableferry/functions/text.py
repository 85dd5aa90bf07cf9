"""Text forms: bytes, times, durations, uptime, schedules, day counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.names import quoted

# Schedule presets and the cron expressions they stand for.
PRESET_CRON = {
    "1min": "*/1 * * * *",
    "5min": "*/5 * * * *",
    "10min": "*/10 * * * *",
    "15min": "*/15 * * * *",
    "30min": "*/30 * * * *",
    "1hour": "0 * * * *",
    "3hour": "0 */3 * * *",
    "6hour": "0 */6 * * *",
    "12hour": "0 */12 * * *",
    "daily": "0 0 * * *",
    "weekly": "0 0 * * 0",
}


def bytes_to_text(df: DataFrame) -> DataFrame:
    """Binary columns decoded as UTF-8, the others as they are."""
    return df.select(
        [
            F.decode(quoted(f.name), "UTF-8").alias(f.name) if isinstance(f.dataType, T.BinaryType) else quoted(f.name)
            for f in df.schema
        ]
    )


def rfc3339(ts: Column) -> Column:
    """A time to the second with its zone: ``2024-01-31T09:30:00Z`` in a UTC session."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")


def flat_text(df: DataFrame) -> DataFrame:
    """Every column as a text sink wants it: times as RFC 3339, nested values as JSON, bytes decoded."""
    out = []
    for f in df.schema:
        col = quoted(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = rfc3339(col)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            col = F.to_json(col)
        elif isinstance(f.dataType, T.BinaryType):
            col = F.decode(col, "UTF-8")
        out.append(col.alias(f.name))
    return df.select(out)


def duration_text(ms: Column) -> Column:
    """``-`` for nothing, ``250ms`` below a second, else ``1.25s``."""
    return (
        F.when(ms.isNull() | (ms == 0), "-")
        .when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .otherwise(F.format_string("%.2fs", ms / F.lit(1000.0)))
    )


def uptime_text(seconds: Column) -> Column:
    """``2d 3h 4m``; leading zero parts are left out, minutes always stay."""
    whole = seconds.cast("bigint")
    days = F.floor(whole / 86400)
    hours = F.floor(F.pmod(whole, F.lit(86400)) / 3600)
    minutes = F.floor(F.pmod(whole, F.lit(3600)) / 60)
    return (
        F.when(days > 0, F.format_string("%dd %dh %dm", days, hours, minutes))
        .when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .otherwise(F.format_string("%dm", minutes))
    )


def days_remaining(expires_at: Column, as_of: Column) -> Column:
    """Whole days left, never below 0."""
    seconds = F.unix_micros(expires_at.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))
    return F.greatest(F.floor(seconds / F.lit(86400 * 1000000)), F.lit(0)).cast("bigint")


def expiring_within(expires_at: Column, as_of: Column, days: int) -> Column:
    return days_remaining(expires_at, as_of) <= days


def preset_to_cron(schedule: Column) -> Column:
    """A preset's cron expression; anything else is kept."""
    table = F.create_map(*[F.lit(x) for pair in PRESET_CRON.items() for x in pair])
    return F.coalesce(table[schedule], schedule)


def numeric_metric(document: Column, path: str) -> Column:
    """A number from a JSON document, NULL when absent or not a number."""
    return F.get_json_object(document, path).try_cast("double")
