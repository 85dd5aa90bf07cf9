import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.infer import infer_schema, infer_types, target_types
from tableferry.functions.names import glob_to_regex, is_valid_name, validate_columns
from tableferry.operators.tables import ensure_table, to_target_types


@pytest.mark.parametrize(
    "cells,want",
    [
        (["1", "2.5"], "double"),
        (["1", "x"], "string"),
        (["true", "FALSE"], "boolean"),
        (["1e5", "NaN"], "double"),
        (["+5", "-3"], "bigint"),
        (["12345678901234567890", "1"], "double"),
        (["", "  "], "string"),
        (["t", "f"], "string"),
        (["1d", "2"], "string"),
        (["1e999"], "string"),
        ([" 7 ", None], "bigint"),
        (["true", "1"], "string"),
        (["Infinity", "-inf"], "double"),
        (["9223372036854775807"], "bigint"),
        ([".5", "5."], "double"),
        (["0x10"], "string"),
    ],
)
def test_column_types(spark, cells, want):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert infer_schema(df)["c"].dataType.simpleString() == want


def test_values_are_cleaned_and_cast(spark, rows):
    df = spark.createDataFrame([(" 007 ", "ü\n", ""), ("8", "x", " ")], "`a.b` string, s string, e string")
    out = infer_types(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "string", "string"]
    assert rows(out) == [(7, "ü", None), (8, "x", None)]
    kept = infer_types(df, string_columns=["a.b"])
    assert rows(kept.select("`a.b`")) == [("007",), ("8",)]


def test_empty_input(spark):
    assert infer_types(spark.createDataFrame([], "a string, b bigint")).dtypes == [("a", "string"), ("b", "bigint")]


def test_target_types(spark):
    df = spark.sql(
        "select 1.0D a, 1.5D b, true c, 'x' d, cast(null as double) e, array(1) f, 2 g, 1e300D h, cast('NaN' as double) i"
    )
    want = ["BIGINT", "DOUBLE PRECISION", "BOOLEAN", "TEXT", "TEXT", "TEXT", "BIGINT", "DOUBLE PRECISION", "DOUBLE PRECISION"]
    assert list(target_types(df).values()) == want
    assert to_target_types(df).schema["a"].dataType == T.LongType()
    assert to_target_types(df).first()["f"] == "[1]"


def test_ensure_table(spark):
    df = spark.sql("select 1 id, 2.5D price, 'x' name, 1 as `bad name`")
    assert ensure_table(spark, "made_once", df)
    assert spark.table("made_once").dtypes == [("id", "bigint"), ("price", "double"), ("name", "string")]
    assert not ensure_table(spark, "made_once", spark.range(1))
    assert spark.table("made_once").columns == ["id", "price", "name"]
    with pytest.raises(ValueError):
        ensure_table(spark, "bad name", df)


def test_names(spark):
    assert is_valid_name("a_1") and not is_valid_name("") and not is_valid_name("a b") and not is_valid_name("x" * 64)
    df = spark.range(1).select(F.lit(1).alias("a b"), F.lit(2).alias("a_b"), F.lit(3).alias("c"))
    assert validate_columns(df).columns == ["a_b", "c"]
    assert validate_columns(df, "rename").columns == ["a_b_2", "a_b", "c"]
    with pytest.raises(ValueError):
        validate_columns(df, "fail")


@pytest.mark.parametrize(
    "pattern,name,want",
    [("*.csv", "a.csv", True), ("*.csv", "a/b.csv", False), ("a?c", "abc", True), ("[ab]1", "b1", True), ("a.b", "axb", False)],
)
def test_glob(spark, pattern, name, want):
    assert spark.range(1).select(F.lit(name).rlike(glob_to_regex(pattern))).first()[0] is want
