"""Reconciliation of a source and a target table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.names import quoted


def compare(source: DataFrame, target: DataFrame, key: str, columns: Sequence[str] | None = None, by_value: bool = False) -> DataFrame:
    """Every key with its ``class`` and, if changed, the ``changed_columns``.

    Classes: ``only_source``, ``only_target``, ``changed``, ``equal``, and
    ``duplicate_key`` for a key that either side holds more than once. NULL
    equals NULL, in the key too. Both sides are read once and meet in one
    aggregate, in which a row is two counts and 96 bits of hash per column: the
    hashes of a key's two rows cancel out where the values are equal. So no row
    is sorted or joined, and a key repeated any number of times reaches the
    shuffle once per task. ``by_value`` lets the values decide instead: a key's
    smallest and largest value of each column meet, which costs a shuffle of
    whole values, and a sort where they are of no fixed length.
    """
    source, target = _hashable(source), _hashable(target)
    columns = list(columns or [c for c in source.columns if c != key and c in target.columns])
    names = {c: f"c{i}" for i, c in enumerate(columns)}

    def side(df: DataFrame, own: int) -> DataFrame:
        values = [quoted(c).alias(n) for c, n in names.items()]
        return df.select(quoted(key).alias("key"), F.lit(own).alias("s"), F.lit(1 - own).alias("t"), *values)

    # The union brings both sides to common types before anything is hashed.
    both = side(source, 1).unionByName(side(target, 0))
    if by_value:
        # Of a key with one row on each side: a value and a NULL are one value in all, and two equal values have no other between them.
        facts = [f(n).alias(f"{a}_{n}") for n in names.values() for a, f in (("n", F.count), ("low", F.min), ("high", F.max))]
        differs = [(F.col(f"n_{n}") == 1) | ~F.col(f"low_{n}").eqNullSafe(F.col(f"high_{n}")) for n in names.values()]
    else:
        facts = [F.bit_xor(f(n)).alias(f"{a}_{n}") for n in names.values() for a, f in (("x", F.xxhash64), ("h", F.hash))]
        differs = [(F.col(f"x_{n}") != 0) | (F.col(f"h_{n}") != 0) for n in names.values()]
    met = both.groupBy("key").agg(F.sum("s").alias("s_rows"), F.sum("t").alias("t_rows"), *facts)
    any_differs = reduce(lambda a, b: a | b, differs, F.lit(False))
    s_rows, t_rows = F.col("s_rows"), F.col("t_rows")
    kind = (
        F.when((s_rows > 1) | (t_rows > 1), "duplicate_key")
        .when(t_rows == 0, "only_source")
        .when(s_rows == 0, "only_target")
        .when(any_differs, "changed")
        .otherwise("equal")
    )
    changed = F.array_compact(F.array(*[F.when(d, F.lit(c)) for c, d in zip(columns, differs)]).cast("array<string>"))
    return met.select(
        F.col("key").alias(key),
        kind.alias("class"),
        s_rows.cast("bigint").alias("source_rows"),
        t_rows.cast("bigint").alias("target_rows"),
        F.when(kind == "changed", F.array_join(changed, ", ")).alias("changed_columns"),
    )


def _hashable(df: DataFrame) -> DataFrame:
    """Maps have no order and no hash: they count as their entries, sorted by key, at any depth as JSON text."""

    def has_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.MapType):
            return True
        if isinstance(kind, T.ArrayType):
            return has_map(kind.elementType)
        return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind.fields)

    def plain(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.MapType) and not has_map(kind.keyType) and not has_map(kind.valueType):
            return F.array_sort(F.map_entries(column))
        return F.to_json(F.struct(column.alias("value")), {"sortKeys": "true"}) if has_map(kind) else column

    return df.select(*[plain(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def compare_summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("class").agg(F.count(F.lit(1)).alias("keys"))
