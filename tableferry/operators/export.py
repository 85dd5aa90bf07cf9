"""Records as files for other tools."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.functions.names import quoted
from tableferry.functions.text import flat_text


# Times with their full precision.
TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


def export_records(df: DataFrame, path: str, format: str, single_file: bool = False) -> None:
    """Write ``csv``, ``json``, ``jsonl`` or ``parquet``; nothing to write is an error.

    ``json`` is an indented array in every part file. ``single_file`` makes one
    part out of all, for small exports only.
    """
    format = format.lower()
    if format not in ("csv", "json", "jsonl", "parquet"):
        raise ValueError(f"unsupported export format: {format} (supported: csv, json, jsonl, parquet)")
    if df.isEmpty():
        raise ValueError("no records to write")
    if single_file:
        df = df.coalesce(1)
    if format == "csv":
        flat_text(df).write.option("header", True).option("escape", '"').csv(path)
    elif format == "jsonl":
        df.write.options(**TIMES).json(path)
    elif format == "parquet":
        df.write.parquet(path)
    else:
        objects = df.select(F.to_json(F.struct("*"), {"pretty": "true", **TIMES}).alias("value"))
        objects.mapInPandas(_as_array, "value string").write.text(path)


def _as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The objects of one part between brackets, commas between them."""
    opening = "["
    for batch in batches:
        if len(batch):
            batch = batch.copy()
            batch["value"] = [opening + batch["value"].iloc[0], *("," + v for v in batch["value"].iloc[1:])]
            opening = ","
            yield batch
    yield pd.DataFrame({"value": ["[]" if opening == "[" else "]"]})


def export_result(df: DataFrame, path: str) -> None:
    """A result grid as CSV with every cell in JSON form (text quoted, NULL as ``null``)."""
    cells = [F.regexp_replace(F.to_json(F.array(quoted(c))), r"(?s)^\[(.*)\]$", "$1").alias(c) for c in df.columns]
    # One column of finished lines. JSON escapes control characters, so neither mark can occur in it.
    lines = df.select(F.concat_ws(",", *cells).alias(",".join(df.columns)))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
