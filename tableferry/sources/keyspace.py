"""Key-value dumps: one row per key with ``key``, ``type``, ``value`` (JSON text) and ``ttl``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.functions.names import key_matches


def scan_keys(dump: DataFrame, pattern: str = "*") -> DataFrame:
    """Keys that match a glob, each value in the column of its type.

    ``string_value`` text, ``hash_value`` map, ``list_value`` array (lists in
    order, sets sorted), ``zset_value`` array of member and score by score.
    """
    kind = F.col("type")
    value = F.col("value")
    items = F.from_json(value, "array<string>")
    members = F.from_json(value, "array<struct<member:string,score:double>>")
    by_score = F.transform(
        F.array_sort(F.transform(members, lambda m: F.struct(m["score"].alias("score"), m["member"].alias("member")))),
        lambda m: F.struct(m["member"].alias("member"), m["score"].alias("score")),
    )
    return dump.filter(key_matches(F.col("key"), pattern)).select(
        "key",
        "type",
        F.col("ttl").cast("double").alias("ttl"),
        F.when(kind == "string", value).alias("string_value"),
        F.when(kind == "hash", F.from_json(value, "map<string,string>")).alias("hash_value"),
        F.when(kind == "list", items).when(kind == "set", F.array_sort(items)).alias("list_value"),
        F.when(kind == "zset", by_score).alias("zset_value"),
    )


def hash_flatten(dump: DataFrame, pattern: str = "*", fields: Sequence[str] | None = None) -> DataFrame:
    """One row per hash key: ``_key`` and a column per field, NULL where a hash lacks it.

    The fields sit in the key's own row, so nothing shuffles. Without ``fields``
    their names are collected first: one name per output column.
    """
    hashes = dump.filter((F.col("type") == "hash") & key_matches(F.col("key"), pattern)).select(
        F.col("key").alias("_key"), F.from_json("value", "map<string,string>").alias("__hash")
    )
    if fields is None:
        names = hashes.select(F.explode(F.map_keys("__hash")).alias("name")).distinct()
        fields = sorted(r[0] for r in names.collect())
    return hashes.select("_key", *[F.col("__hash")[f].alias(f) for f in fields])


def hash_flatten_rows(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The same for a dump with one row per ``(key, field, value)``; partial aggregation comes first."""
    return rows.groupBy(F.col("key").alias("_key")).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    )
