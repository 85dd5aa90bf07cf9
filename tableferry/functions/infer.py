"""Whole-column type inference for text, and the cleaning that goes with it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.names import quoted

# White space trimmed from cells, and what counts as a number or a truth value.
WHITESPACE = " \t\n\r\u000b\f\u0085 "
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NOT_FINITE = r"^(?i)(nan|[+-]?inf|[+-]?infinity)$"

COLUMNS_AT_A_TIME = 32

# One bit per class of cell, so that one bit_or per column sees them all.
LONG, DOUBLE, BOOL, STRING = 1, 2, 4, 8


def trim_space(cell: Column) -> Column:
    """Both sides trimmed. Trimming a set of characters walks the whole text, so it is left out where nothing is to trim."""
    padded = reduce(or_, [cell.startswith(ch) | cell.endswith(ch) for ch in WHITESPACE])
    return F.when(padded, F.btrim(cell, F.lit(WHITESPACE))).otherwise(cell)


def cell_class(cell: Column) -> Column:
    """The class bit of one cleaned cell that is not NULL.

    The patterns guard the casts, which alone would accept more (``1d``, ``t``),
    and which are slow for text they cannot take. First characters and lengths
    guard the patterns, which would copy every long text.
    """
    as_double = cell.try_cast("double")
    number_like = F.substring(cell, 1, 1).isin(*"+-.0123456789")
    size = F.octet_length(cell)
    return (
        F.when(number_like & cell.rlike(INTEGER) & cell.try_cast("bigint").isNotNull(), F.lit(LONG))
        .when(number_like & cell.rlike(NUMBER) & (F.abs(as_double) < F.lit(float("inf"))), F.lit(DOUBLE))
        .when((size <= len("+infinity")) & cell.rlike(NOT_FINITE), F.lit(DOUBLE))
        .when((size <= len("false")) & F.lower(cell).isin("true", "false"), F.lit(BOOL))
        .otherwise(F.lit(STRING))
    )


def type_of_mask(mask: int | None) -> T.DataType:
    """The column type that holds every class seen: LONG < DOUBLE < STRING, BOOL < STRING."""
    if mask == LONG:
        return T.LongType()
    if mask in (DOUBLE, LONG | DOUBLE):
        return T.DoubleType()
    if mask == BOOL:
        return T.BooleanType()
    return T.StringType()


def infer_schema(df: DataFrame, string_columns: Sequence[str] = ()) -> T.StructType:
    """One aggregate over the text columns; a bit mask per column comes back.

    Columns are classified where they stand, in aggregates of so many columns
    that the generated code stays compiled; a very wide table takes a few of them.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in string_columns]
    masks = {}
    if text:
        for at in range(0, len(text), COLUMNS_AT_A_TIME):
            group = text[at : at + COLUMNS_AT_A_TIME]
            cleaned = df.select([F.nullif(trim_space(quoted(c)), F.lit("")).alias(f"c{i}") for i, c in enumerate(group)])
            seen = [F.bit_or(F.when(F.col(f"c{i}").isNotNull(), cell_class(F.col(f"c{i}")))) for i in range(len(group))]
            masks |= dict(zip(group, cleaned.agg(*seen).first()))
    return T.StructType(
        [T.StructField(f.name, type_of_mask(masks[f.name]) if f.name in masks else f.dataType) for f in df.schema]
    )


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Clean the text columns and cast them to a known schema."""
    types = {f.name: f.dataType for f in schema}
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    trimmed = df.select(
        [trim_space(quoted(c)).alias(c) if c in text else quoted(c) for c in df.columns]
    )
    out = []
    for name in df.columns:
        col = quoted(name)
        if name in text:
            col = F.nullif(col, F.lit(""))
            if not isinstance(types[name], T.StringType):
                col = col.try_cast(types[name])
        out.append(col.alias(name))
    return trimmed.select(out)


def infer_types(df: DataFrame, string_columns: Sequence[str] = (), schema: T.StructType | None = None) -> DataFrame:
    """Text columns with their inferred types. A given ``schema`` saves the inference pass."""
    return apply_schema(df, schema or infer_schema(df, string_columns))


def target_types(df: DataFrame) -> dict[str, str]:
    """The four column types a created table gets, by column.

    Whole numbers, and doubles that are whole in every row, become BIGINT.
    Values of the other types, nested ones included, become TEXT.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    real = (T.FloatType, T.DoubleType, T.DecimalType)
    doubles = [f.name for f in df.schema if isinstance(f.dataType, real)]
    integral = {}
    if doubles:
        bound = 2.0**63
        checks = []
        for i, name in enumerate(doubles):
            value = quoted(name).cast("double")
            fits = (F.floor(value) == value) & (value >= -bound) & (value < bound)
            checks.append(F.bool_and(fits).alias(f"b{i}"))
        integral = dict(zip(doubles, df.agg(*checks).first()))
    out = {}
    for field in df.schema:
        if isinstance(field.dataType, whole) or integral.get(field.name):
            out[field.name] = "BIGINT"
        elif isinstance(field.dataType, real):
            # A column without a single value says nothing about its type.
            out[field.name] = "TEXT" if integral[field.name] is None else "DOUBLE PRECISION"
        elif isinstance(field.dataType, T.BooleanType):
            out[field.name] = "BOOLEAN"
        else:
            out[field.name] = "TEXT"
    return out
