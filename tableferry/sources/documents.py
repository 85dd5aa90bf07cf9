"""Filters and aggregate stages over landed documents."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: _one_of(c, v),
    "$nin": lambda c, v: ~_one_of(c, v),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def _one_of(col: Column, values: Sequence[Any]) -> Column:
    plain = [v for v in values if v is not None]
    hit = F.coalesce(col.isin(*plain), F.lit(False)) if plain else F.lit(False)
    return hit | col.isNull() if len(plain) < len(values) else hit


def _field(schema: T.StructType, path: str) -> Column:
    """A dotted path; a field no document has is NULL."""
    at: T.DataType = schema
    for part in path.split("."):
        if not isinstance(at, T.StructType) or part not in at.fieldNames():
            return F.lit(None)
        at = at[part].dataType
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def predicate(schema: T.StructType, wanted: Mapping[str, Any]) -> Column:
    """A filter document as a predicate Spark can push into the scan.

    Fields combine by AND. A missing field equals NULL, so ``$ne`` and ``$nin``
    hold for it. An unknown operator raises.
    """
    tests = [F.lit(True)]
    for name, value in wanted.items():
        if name in ("$and", "$or"):
            parts = [predicate(schema, v) for v in value]
            tests.append(reduce(lambda a, b: a & b if name == "$and" else a | b, parts))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator: {name}")
        elif isinstance(value, Mapping) and any(k.startswith("$") for k in value):
            for op, operand in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator: {op}")
                tests.append(_COMPARE[op](_field(schema, name), operand))
        elif isinstance(value, Mapping):
            tests += [predicate(schema, {f"{name}.{k}": v for k, v in value.items()})]
        else:
            tests.append(_COMPARE["$eq"](_field(schema, name), value))
    return reduce(lambda a, b: a & b, tests)


def find(df: DataFrame, wanted: Mapping[str, Any] | str | None, on_invalid: str = "raise") -> DataFrame:
    """Documents that match a filter, given as a mapping or as JSON text.

    Text that is not a JSON object raises; ``on_invalid="all"`` selects every
    document instead.
    """
    if not wanted:
        return df
    if isinstance(wanted, str):
        try:
            wanted = json.loads(wanted)
            if not isinstance(wanted, dict):
                raise ValueError("a filter is a JSON object")
        except ValueError:
            if on_invalid == "all":
                return df
            raise
    return df.filter(predicate(df.schema, wanted))


_ACCUMULATE = {
    "$sum": F.sum,
    "$avg": F.avg,
    "$min": F.min,
    "$max": F.max,
    "$count": lambda _: F.count(F.lit(1)),
}


def _operand(schema: T.StructType, value: Any) -> Column:
    return _field(schema, value[1:]) if isinstance(value, str) and value.startswith("$") else F.lit(value)


def _group(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    by = spec["_id"]
    if isinstance(by, Mapping):
        keys = [_operand(df.schema, v).alias(k) for k, v in by.items()]
    else:
        keys = [] if by is None else [_operand(df.schema, by).alias("_id")]
    aggs = []
    for name, acc in spec.items():
        if name == "_id":
            continue
        ((op, operand),) = acc.items()
        if op not in _ACCUMULATE:
            raise ValueError(f"unknown accumulator: {op}")
        aggs.append(_ACCUMULATE[op](_operand(df.schema, operand)).alias(name))
    return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()


def _project(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    if all(v in (0, False) for v in spec.values()):
        return df.drop(*spec)
    return df.select(
        [
            (_field(df.schema, k) if v in (1, True) else _operand(df.schema, v)).alias(k)
            for k, v in spec.items()
            if v not in (0, False)
        ]
    )


def _unwind(df: DataFrame, spec: str) -> DataFrame:
    name = spec.removeprefix("$")
    return df.withColumn(name, F.explode(F.col(name)))


def _sort(df: DataFrame, spec: Mapping[str, int]) -> DataFrame:
    return df.orderBy(*[F.col(k).asc_nulls_first() if d > 0 else F.col(k).desc_nulls_last() for k, d in spec.items()])


_STAGES = {
    "$match": find,
    "$project": _project,
    "$group": _group,
    "$unwind": _unwind,
    "$sort": _sort,
    "$limit": lambda df, n: df.limit(n),
    "$skip": lambda df, n: df.offset(n),
    "$count": lambda df, name: df.agg(F.count(F.lit(1)).alias(name)),
}


def aggregate(df: DataFrame, stages: Sequence[Mapping[str, Any]]) -> DataFrame:
    """A list of stages as one chain of DataFrame operations, planned by Spark as a whole."""
    for stage in stages:
        ((name, spec),) = stage.items()
        if name not in _STAGES:
            raise ValueError(f"unknown stage: {name}")
        df = _STAGES[name](df, spec)
    return df
