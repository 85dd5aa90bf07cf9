"""Statements before and after a run, and checks of endpoints."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tableferry.session import path_exists
from tableferry.spec import Endpoint

log = logging.getLogger("tableferry")


def run_hooks(execute: Callable[[str], object], statements: Sequence[str], on_error: str = "warn") -> list[str]:
    """Run statements in order and return the errors. ``warn`` logs and goes on, ``fail`` raises."""
    errors = []
    for sql in statements:
        if not sql.strip():
            continue
        try:
            execute(sql)
        except Exception as error:  # noqa: BLE001 - a hook may fail in any way
            if on_error == "fail":
                raise
            log.warning("hook failed: %s", error)
            errors.append(str(error))
    return errors


def sql_executor(spark: SparkSession, endpoint: Endpoint) -> Callable[[str], object]:
    """Where an endpoint's hooks run: at its database, or in this session."""
    if endpoint.format == "jdbc":
        from tableferry.operators.jdbc_sink import execute

        options = dict(endpoint.options)
        url = options.pop("url")
        return lambda sql: execute(spark, url, [sql], options)
    return lambda sql: spark.sql(sql)


def check_endpoint(spark: SparkSession, endpoint: Endpoint) -> DataFrame:
    """``(success, message, duration_ms, version)`` of one small request."""
    start = time.monotonic()
    try:
        if endpoint.format == "jdbc":
            spark.read.format("jdbc").options(**endpoint.options).option("query", "select 1 as ok").load().first()
            ok, message = True, "Connection successful"
        else:
            ok = path_exists(spark, endpoint.path or "")
            message = "Connection successful" if ok else f"path not found: {endpoint.path}"
    except Exception as error:  # noqa: BLE001 - the outcome is the answer
        ok, message = False, str(error)
    row = (ok, message, int((time.monotonic() - start) * 1000), spark.version)
    return spark.createDataFrame([row], "success boolean, message string, duration_ms bigint, version string")
