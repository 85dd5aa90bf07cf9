"""Extraction from a database, read in parallel ranges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# How each dialect quotes a name, and where it lists schemas, tables and columns.
QUOTES = {"postgres": ('"', '"'), "mysql": ("`", "`"), "sqlserver": ("[", "]"), "oracle": ('"', '"')}
SCHEMA_QUERIES = {
    "postgres": "select schema_name from information_schema.schemata where schema_name not in "
    "('information_schema', 'pg_catalog', 'pg_toast') and schema_name not like 'pg_temp%'",
    "mysql": "select database() as schema_name",
    "sqlserver": "select name as schema_name from sys.schemas",
    "oracle": "select username as schema_name from all_users",
}
# Where each dialect keeps its estimates of row counts.
ESTIMATE_QUERIES = {
    "postgres": "select schemaname as schema, relname as table_name, n_live_tup as row_count from pg_stat_user_tables",
    "mysql": "select table_schema as schema, table_name, table_rows as row_count from information_schema.tables",
    "sqlserver": "select s.name as [schema], t.name as table_name, sum(p.rows) as row_count from sys.tables t "
    "join sys.schemas s on s.schema_id = t.schema_id join sys.partitions p on p.object_id = t.object_id "
    "and p.index_id in (0, 1) group by s.name, t.name",
    "oracle": 'select owner as "schema", table_name, num_rows as row_count from all_tables',
}
FETCH_ROWS = 25_000


def quote(name: str, dialect: str) -> str:
    left, right = QUOTES[dialect]
    return f"{left}{name.replace(right, right * 2)}{right}"


def table_query(table: str, dialect: str, schema: str | None = None) -> str:
    """The extraction a bulk sync makes for one table."""
    prefix = f"{quote(schema, dialect)}." if schema else ""
    return f"SELECT * FROM {prefix}{quote(table, dialect)}"


def read_query(
    spark: SparkSession, url: str, query: str, options: Mapping[str, str] | None = None, fetch_rows: int = FETCH_ROWS
) -> DataFrame:
    """One query at the database, one connection; filters on the result are pushed into it."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_rows).options(**(options or {}))
    return reader.option("query", query).load()


def read_ranges(
    spark: SparkSession,
    url: str,
    query: str,
    column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
    options: Mapping[str, str] | None = None,
    fetch_rows: int = FETCH_ROWS,
) -> DataFrame:
    """The same query read in parallel, one range of ``column`` per connection.

    The bounds only set the width of the ranges; rows outside them are read too.
    """
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("fetchsize", fetch_rows)
        .options(**(options or {}))
        .option("dbtable", f"({query}) q")
        .option("partitionColumn", column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def sql_literal(value) -> str:
    """A checkpoint as a literal of its own type, for a query that runs at the database."""
    if value is None:
        return "'0'"
    if isinstance(value, bool):
        raise TypeError("a checkpoint is a number, a time or text")
    if isinstance(value, (int, float)):
        return repr(value)
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return "'" + text.replace("'", "''") + "'"


def bind_checkpoint(query: str, checkpoint) -> str:
    """The checkpoint put into the text of a query for a remote database."""
    from tableferry.sources.sql import CHECKPOINT_PLACEHOLDER

    return CHECKPOINT_PLACEHOLDER.sub(lambda _: sql_literal(checkpoint), query)


def list_schemas(spark: SparkSession, url: str, dialect: str, options: Mapping[str, str] | None = None) -> DataFrame:
    return read_query(spark, url, SCHEMA_QUERIES[dialect], options)


def list_tables(
    spark: SparkSession, url: str, options: Mapping[str, str] | None = None, schema: str | None = None, dialect: str = "postgres"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base tables, row estimates and ordered columns from the database's own lists, for ``join_discovery``."""
    where = "table_schema not in ('information_schema', 'pg_catalog', 'mysql', 'performance_schema', 'sys')"
    if schema:
        where += f" and table_schema = {sql_literal(schema)}"
    tables = read_query(
        spark,
        url,
        "select table_schema as schema, table_name from information_schema.tables "
        f"where table_type = 'BASE TABLE' and {where}",
        options,
    )
    columns = read_query(
        spark,
        url,
        "select table_schema as schema, table_name, ordinal_position as position, column_name "
        f"from information_schema.columns where {where}",
        options,
    )
    return tables, read_query(spark, url, ESTIMATE_QUERIES[dialect], options), columns
