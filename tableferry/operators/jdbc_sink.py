"""Writes into a database: parallel load of a staging table, then one merge statement."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tableferry.functions.infer import target_types
from tableferry.functions.names import is_valid_name, validate_columns
from tableferry.operators.dedupe import latest_per_key
from tableferry.operators.tables import to_target_types
from tableferry.session import delete_folder, scratch_dir
from tableferry.sources.jdbc import quote

# Rows per insert statement batch.
BATCH_ROWS = 5_000


def _name(name: str) -> str:
    if not is_valid_name(name):
        raise ValueError(f"invalid name: {name!r}")
    return name


def merge_statement(table: str, staging: str, columns: Sequence[str], key: str, dialect: str) -> str:
    """One statement that inserts or updates ``table`` from ``staging`` by ``key``.

    Non-key columns of the staging table overwrite, NULL included. A table with
    a key and nothing else only gets the missing rows.
    """
    for name in (table, staging, key, *columns):
        _name(name)

    def q(name: str) -> str:
        return quote(name, dialect)

    others = [c for c in columns if c != key]
    names = ", ".join(q(c) for c in columns)
    head = f"INSERT INTO {q(table)} ({names}) SELECT {names} FROM {q(staging)}"
    if dialect == "postgres":
        # WHERE TRUE keeps ON from being read as a join condition.
        sets = ", ".join(f"{q(c)} = EXCLUDED.{q(c)}" for c in others)
        return f"{head} WHERE TRUE ON CONFLICT ({q(key)}) DO " + (f"UPDATE SET {sets}" if others else "NOTHING")
    if dialect == "mysql":
        sets = ", ".join(f"{q(c)} = VALUES({q(c)})" for c in others or [key])
        return f"{head} ON DUPLICATE KEY UPDATE {sets}"
    if dialect in ("oracle", "sqlserver"):
        update = ", ".join(f"{q(c)} = s.{q(c)}" for c in others)
        values = ", ".join(f"s.{q(c)}" for c in columns)
        return (
            f"MERGE INTO {q(table)} t USING {q(staging)} s ON (t.{q(key)} = s.{q(key)})"
            + (f" WHEN MATCHED THEN UPDATE SET {update}" if others else "")
            + f" WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"
            + (";" if dialect == "sqlserver" else "")
        )
    raise ValueError(f"unknown dialect: {dialect}")


def next_key_statement(table: str, key: str = "id") -> str:
    """Sets a postgres sequence to the next free key; other databases need no such step."""
    t, k = quote(_name(table), "postgres"), quote(_name(key), "postgres")
    return (
        f"SELECT setval(pg_get_serial_sequence('{t}', '{key}'), COALESCE((SELECT MAX({k}) FROM {t}), 0) + 1, false)"
    )


def _connection(spark: SparkSession, url: str, options: Mapping[str, str] | None):
    options = dict(options or {})
    if "driver" in options:
        spark._jvm.java.lang.Class.forName(options["driver"])
    properties = spark._jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, value)
    return spark._jvm.java.sql.DriverManager.getConnection(url, properties)


def execute(spark: SparkSession, url: str, statements: Sequence[str], options: Mapping[str, str] | None = None) -> None:
    """Run statements on one connection, as one transaction, from the driver."""
    connection = _connection(spark, url, options)
    try:
        connection.setAutoCommit(False)
        for sql in statements:
            statement = connection.createStatement()
            statement.execute(sql)
            statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def column_types(types: Mapping[str, str], dialect: str = "postgres") -> str:
    """The types a created table gets, as Spark's JDBC writer takes them."""
    names = {"mysql": {"DOUBLE PRECISION": "DOUBLE"}, "oracle": {"BIGINT": "NUMBER(19)", "TEXT": "CLOB"}}
    rename = names.get(dialect, {})
    return ", ".join(f"`{c}` {rename.get(t, t)}" for c, t in types.items())


def jdbc_append(
    df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None, dialect: str = "postgres"
) -> None:
    """Append in parallel, one connection per partition; the table is created if missing."""
    types = target_types(validate_columns(df))
    rows = to_target_types(df, types=types)
    writer = rows.write.format("jdbc").option("url", url).option("dbtable", quote(_name(table), dialect))
    writer = writer.option("batchsize", BATCH_ROWS).option("createTableColumnTypes", column_types(types, dialect))
    writer.options(**(options or {})).mode("append").save()


def jdbc_truncate_load(
    df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None, dialect: str = "postgres"
) -> None:
    """Replace a table's rows and keep its definition."""
    writer = to_target_types(df).write.format("jdbc").option("url", url)
    writer = writer.option("dbtable", quote(_name(table), dialect)).option("truncate", "true")
    writer.option("batchsize", BATCH_ROWS).options(**(options or {})).mode("overwrite").save()


def drop_statement(table: str, dialect: str) -> str:
    """Plain, since not every listed database knows IF EXISTS."""
    return f"DROP TABLE {quote(_name(table), dialect)}"


def key_statement(table: str, key: str, dialect: str) -> str:
    """The unique key that a merge by conflict needs on a table made here."""
    return f"ALTER TABLE {quote(_name(table), dialect)} ADD PRIMARY KEY ({quote(_name(key), dialect)})"


def table_exists(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None) -> bool:
    """Whether the database lists the table; an error of the connection is an error, not a missing table."""
    connection = _connection(spark, url, options)
    try:
        schema, _, name = _name(table).rpartition(".")
        found = connection.getMetaData().getTables(None, schema or None, name, None)
        return bool(found.next())
    finally:
        connection.close()


def jdbc_ensure(
    df: DataFrame, url: str, table: str, key: str, options: Mapping[str, str] | None = None, dialect: str = "postgres"
) -> bool:
    """Create the target of a merge if it is missing, without rows; True if created.

    A key that is not a number is left without a constraint, which text columns do not take everywhere.
    """
    spark = df.sparkSession
    if table_exists(spark, url, table, options):
        return False
    types = target_types(validate_columns(df))
    jdbc_append(df.limit(0), url, table, options, dialect)
    if types.get(key) == "BIGINT":
        execute(spark, url, [key_statement(table, key, dialect)], options)
    return True


def jdbc_merge(
    df: DataFrame,
    url: str,
    table: str,
    key: str,
    order_by: Sequence[str],
    dialect: str,
    options: Mapping[str, str] | None = None,
) -> None:
    """Upsert into a database table.

    Deduplicated rows are written once to the shared folder, so that finding
    their types and loading them do not compute them again. They load into a
    staging table in parallel; one statement then merges them and the staging
    table goes. If anything fails before that statement commits, the target is
    as it was. A target that is missing is created first, with its key.
    """
    _name(table), _name(key)
    spark = df.sparkSession
    path = scratch_dir(spark, "jdbc-merge")
    latest_per_key(df, key, order_by).write.parquet(path)
    latest = spark.read.schema(df.schema).parquet(path)
    columns = validate_columns(latest).columns
    staging = f"stage_{uuid.uuid4().hex[:16]}"
    try:
        jdbc_ensure(latest, url, table, key, options, dialect)
        jdbc_append(latest, url, staging, options, dialect)
        execute(spark, url, [merge_statement(table, staging, columns, key, dialect)], options)
    except Exception:
        # The first error is the one to report; a staging table that was never made cannot be dropped.
        with contextlib.suppress(Exception):
            execute(spark, url, [drop_statement(staging, dialect)], options)
        raise
    else:
        execute(spark, url, [drop_statement(staging, dialect)], options)
    finally:
        delete_folder(spark, path)
