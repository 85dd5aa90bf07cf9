"""Extraction by SQL over registered views, and discovery of tables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# The placeholder for the last checkpoint, and what it stands for before the first run.
CHECKPOINT_PLACEHOLDER = re.compile(r"'?\{\{\s*ca_pointer\s*\}\}'?", re.IGNORECASE)
CHECKPOINT_START = "0"
TIME_START = "0001-01-01 00:00:00"
_START_CAST = re.compile(rf"cast\({CHECKPOINT_START} as (timestamp_ntz|timestamp|date)\)")


def register_tables(spark: SparkSession, paths: Mapping[str, str]) -> None:
    """Parquet folders as views, so that rules can name them."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def sql_extract(spark: SparkSession, query: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run a rule's SQL; values are bound, not pasted into the text."""
    return spark.sql(query, args=dict(args or {}))


def incremental_extract(spark: SparkSession, query: str, checkpoint: Any = None) -> DataFrame:
    """Run SQL in which ``{{ca_pointer}}``, in any spelling of case, stands for the last checkpoint.

    The value is bound with its own type, so the comparison in the query stays
    a plain range predicate that the scan can use. Before the first run it is
    ``0``, or the first moment there is when the query compares it with a time.
    """
    # A time without a zone stays one: it then compares with either kind of column
    # without a cast around the column, which would hide it from the scan.
    naive = isinstance(checkpoint, datetime) and checkpoint.tzinfo is None
    marker = "cast(:ca_pointer as timestamp_ntz)" if naive else ":ca_pointer"
    bound, found = CHECKPOINT_PLACEHOLDER.subn(marker, query)
    if not found:
        return spark.sql(query)
    if checkpoint is not None:
        return spark.sql(bound, args={"ca_pointer": checkpoint})
    first = spark.sql(bound, args={"ca_pointer": CHECKPOINT_START})
    # What Spark would cast the start to tells what the query compares it with; a time cannot be read from a 0.
    kind = _START_CAST.search(first._jdf.queryExecution().analyzed().toString())
    if not kind:
        return first
    start = f"cast('{TIME_START}' as {kind.group(1)})"
    return spark.sql(CHECKPOINT_PLACEHOLDER.sub(start, query))


def describe_columns(df: DataFrame) -> DataFrame:
    """Ordered ``(position, name, type)`` of a result, known without running it."""
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def query_metadata(df: DataFrame) -> DataFrame:
    """``(position, name, type, row_count)`` of a result; the rows are counted where they are."""
    fields = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema)
    ]
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select(F.explode(F.array(*fields)).alias("f"), "row_count").select("f.*", "row_count")


def query_preview(df: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first rows of an ad-hoc result and its typed columns. The whole result goes to a sink."""
    return df.limit(limit), describe_columns(df)


def observe_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Count rows while they are written, without another pass."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def discover(spark: SparkSession, tables: Mapping[str, DataFrame], schema: str = "default") -> DataFrame:
    """``(schema, table_name, row_count, columns)`` of base tables, all counts in one job.

    Counts need no column data: Parquet answers them from its footers.
    """
    if not tables:
        return spark.createDataFrame([], "schema string, table_name string, row_count bigint, columns string")
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(schema).alias("schema"),
            F.lit(name).alias("table_name"),
            F.col("row_count"),
            F.lit(", ".join(df.columns)).alias("columns"),
        )
        for name, df in sorted(tables.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def discover_catalog(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """``discover`` over the session catalog's base tables; views are left out."""
    found = spark.catalog.listTables(schema)
    names = [t.name for t in found if t.tableType in ("MANAGED", "EXTERNAL") and not t.isTemporary]
    prefix = f"`{schema}`." if schema else ""
    return discover(spark, {n: spark.table(f"{prefix}`{n}`") for n in names}, schema or spark.catalog.currentDatabase())


def join_discovery(tables: DataFrame, estimates: DataFrame, columns: DataFrame) -> DataFrame:
    """Discovery from catalog views: tables, their row estimates and their ordered columns.

    ``columns`` has ``(table_name, position, column_name)``. With a column ``schema``
    in all three, tables of one name in two schemas are two tables. A table without an
    estimate counts 0 rows, one without columns has an empty list.
    """
    key = ["schema", "table_name"] if "schema" in tables.columns else ["table_name"]
    ordered = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    names = columns.groupBy(*key).agg(
        F.array_join(F.transform(ordered, lambda c: c["column_name"]), ", ").alias("columns")
    )
    return (
        tables.join(estimates, key, "left")
        .join(names, key, "left")
        .select(
            *key,
            F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"),
            F.coalesce("columns", F.lit("")).alias("columns"),
        )
    )


# Schemas that belong to the database system and are not listed.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys")


def list_schemas(spark: SparkSession) -> DataFrame:
    """The catalog's own schemas in order."""
    names = sorted(d.name for d in spark.catalog.listDatabases() if d.name not in SYSTEM_SCHEMAS)
    return spark.createDataFrame([(n,) for n in names], "schema_name string")
