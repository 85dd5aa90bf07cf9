"""The next free key of a table after a load."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.functions.names import quoted


def next_key(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(table_name, next_key, error)``: the greatest key plus 1, or 1 for an empty table.

    ``tables`` maps a name to its DataFrame and key column. A table without that
    column, or with a key that is not a whole number, becomes an error row and does
    not stop the others. All in one job.
    """
    parts = []
    for name, (df, key) in sorted(tables.items()):
        if key in df.columns:
            number = quoted(key).try_cast("bigint")
            # A fraction is cut by the cast, so the value must come back from it.
            whole = number.isNotNull() & (quoted(key).try_cast("decimal(38,18)") == number.cast("decimal(38,18)"))
            bad = F.count_if(quoted(key).isNotNull() & ~F.coalesce(whole, F.lit(False)))
            found = df.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_key"), bad.alias("bad"))
            problem = F.concat(F.col("bad").cast("string"), F.lit(f" values of {key} are not whole numbers"))
            parts.append(
                found.select(
                    F.lit(name).alias("table_name"),
                    F.when(F.col("bad") == 0, F.col("next_key")).alias("next_key"),
                    F.when(F.col("bad") > 0, problem).alias("error"),
                )
            )
        else:
            parts.append(
                spark.range(1).select(
                    F.lit(name).alias("table_name"),
                    F.lit(None).cast("bigint").alias("next_key"),
                    F.lit(f"no column {key}").alias("error"),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
