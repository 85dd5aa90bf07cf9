"""User transforms: a Python callable over named DataFrames and bound SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Query = Callable[..., DataFrame]
Transform = Callable[[Query, Mapping[str, DataFrame]], DataFrame]


def run_transform(
    spark: SparkSession,
    transforms: Transform | Sequence[tuple[str, Transform]],
    inputs: Mapping[str, DataFrame],
    params: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Run one transform, or several in order, and return the last result.

    A transform gets ``query(sql, **args)``, whose values are bound, and the
    named inputs, which are also views for its SQL. Each result is a view for
    the transforms after it. Nothing runs until the caller writes the result;
    an error in a transform stops the run.
    """
    steps = [("result", transforms)] if callable(transforms) else list(transforms)
    frames = dict(inputs)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)

    def query(sql: str, **args: Any) -> DataFrame:
        return spark.sql(sql, args={**(params or {}), **args})

    out = None
    for name, step in steps:
        out = step(query, frames)
        if not isinstance(out, DataFrame):
            raise TypeError(f"transform {name!r} must return a DataFrame")
        out.createOrReplaceTempView(name)
        frames[name] = out
    return out
