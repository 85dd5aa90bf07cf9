"""One row per key, and the latest N rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.names import quoted


_UNORDERED = (T.MapType, T.VariantType)


def _order_names(df: DataFrame, key: str, order_by: Sequence[str]) -> list[str]:
    return [*order_by, *[c for c in df.columns if c != key and c not in order_by]]


def _orderable(field: T.StructField) -> Column:
    """Maps and variants have no order of their own, so their JSON text stands in."""
    if isinstance(field.dataType, _UNORDERED):
        return F.to_json(quoted(field.name))
    return quoted(field.name)


def total_order(df: DataFrame, key: str, order_by: Sequence[str]) -> Column:
    """A struct that orders the rows of a key without ties: ``order_by``, then all other columns."""
    by_name = {f.name: f for f in df.schema}
    names = _order_names(df, key, order_by) or [key]
    return F.struct(*[_orderable(by_name[n]).alias(f"o{i}") for i, n in enumerate(names)])


def split_null_keys(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a key, rows without. The latter never match anything, and together
    they would all land in one shuffle partition."""
    return df.filter(quoted(key).isNotNull()), df.filter(quoted(key).isNull())


def one_per_key(df: DataFrame, key: str, order_by: Sequence[str], pick: str = "last") -> DataFrame:
    """One row per non-NULL key: the greatest (``last``) or least (``first``) in the total order.

    An aggregate, not a window: each task hands on at most one row per key, so a
    key that holds a third of all rows costs no more shuffle than any other.
    """
    if pick not in ("first", "last"):
        raise ValueError("pick is 'first' or 'last'")
    keyed, _ = split_null_keys(df, key)
    if len(df.columns) == 1:
        return keyed.distinct()
    names = _order_names(df, key, order_by)
    if any(isinstance(df.schema[n].dataType, _UNORDERED) for n in names):
        choose = F.max_by if pick == "last" else F.min_by
        row = choose(F.struct(*[quoted(c) for c in names]), total_order(df, key, order_by))
    else:
        # The order takes in every column, so the greatest struct is the row itself.
        row = (F.max if pick == "last" else F.min)(F.struct(*[quoted(c) for c in names]))
    best = keyed.groupBy(quoted(key).alias(key)).agg(row.alias("__row"))
    return best.select([quoted(c) if c == key else F.col("__row").getField(c).alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """The latest row of each key; rows without a key are all kept."""
    _, keyless = split_null_keys(df, key)
    return one_per_key(df, key, order_by).unionByName(keyless)


def latest_n_per_key(df: DataFrame, key: str, order_by: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order.

    Spark limits each group before the shuffle, so a task hands on at most ``n`` rows per key.
    """
    window = Window.partitionBy(quoted(key)).orderBy(*order_by)
    return df.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= n).drop("__n")
