"""Landed API responses: ``request_id``, ``url``, ``status``, ``attempt``, ``body``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.operators.dedupe import one_per_key


def response_class(status: Column) -> Column:
    """``ok`` for 2xx, ``retryable`` for 429 and 5xx, ``final`` for any other failure."""
    return (
        F.when((status >= 200) & (status < 300), "ok")
        .when((status == 429) | (status >= 500), "retryable")
        .otherwise("final")
    )


def final_responses(responses: DataFrame) -> DataFrame:
    """The last attempt of each request and how it ended."""
    last = one_per_key(responses, "request_id", ["attempt"])
    return last.withColumn("outcome", response_class(F.col("status")))


def _read(responses: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    """One row per record of the responses that succeeded, with its fields and ``bad``; a body that cannot be read is one bad row."""
    inner = F.get_json_object("body", "$.data")
    # A field called ``data`` wraps the records only if it is an array; otherwise it is a field of the one record.
    body = F.when(F.startswith(F.ltrim(inner), F.lit("[")), inner).otherwise(F.col("body"))
    ok = final_responses(responses).filter(F.col("outcome") == "ok").select("request_id", "status", "attempt", "body", F.try_parse_json(body).alias("whole"))
    kind = F.schema_of_variant("whole")
    many = F.expr("cast(whole as array<variant>)")
    parts = F.when(F.startswith(kind, F.lit("ARRAY")), many).when(F.startswith(kind, F.lit("OBJECT")), F.array("whole"))
    nothing = F.array(F.lit(None).cast("variant"))
    rows = ok.withColumn("record", F.explode(F.coalesce(parts, nothing)))
    fields, read, wrong = T.StructType.fromDDL(schema).fields, [], ~F.startswith(F.schema_of_variant("record"), F.lit("OBJECT"))
    for i, field in enumerate(fields):
        place = "$['" + field.name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        value = F.try_variant_get("record", place, field.dataType.simpleString())
        there = F.try_variant_get("record", place, "variant")
        read.append(value.alias(f"f{i}"))
        wrong = wrong | (there.isNotNull() & ~F.is_variant_null(there) & value.isNull())
    bad = F.coalesce(wrong, F.lit(True)).alias("bad")
    return rows.select("request_id", "status", "attempt", "body", F.to_json("record").alias("text"), bad, *read), [f.name for f in fields]


def response_records(responses: DataFrame, schema: str) -> DataFrame:
    """Records of the responses that succeeded.

    ``schema`` is the DDL of one record. A body is an array, a single object, or
    an object that wraps the records in an array ``data``. What cannot be read, be it a body, a record or one of its
    fields, is in ``response_rejects``.
    """
    rows, names = _read(responses, schema)
    return rows.filter(~F.col("bad")).select("request_id", *[F.col(f"f{i}").alias(n) for i, n in enumerate(names)])


def response_rejects(responses: DataFrame, schema: str) -> DataFrame:
    """What cannot be read of responses that succeeded: ``request_id, status, attempt, body``, the body whole or one record of it."""
    rows, _ = _read(responses, schema)
    return rows.filter("bad").select("request_id", "status", "attempt", F.coalesce("text", "body").alias("body"))
