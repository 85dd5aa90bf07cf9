"""Steps that must not be computed twice, kept in the shared scratch folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.session import BROADCAST_BYTES, scratch_dir, stored_bytes


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read of the files, not the steps before.
    """
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(spark: SparkSession, df: DataFrame, stored: DataFrame) -> DataFrame:
    """``df``, which is made from the files of ``stored``: sent to all executors if those are small, else joined as it is."""
    folders = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
    return F.broadcast(df) if sum(stored_bytes(spark, f) for f in folders) <= BROADCAST_BYTES // 8 else df


# A table of bits keeps rows without a partner out of a join: at least 16 for each key, but no more than this many words of 64.
WORDS = 1 << 18


def thinned(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose value of the column of ``keys`` may be among these: none that is is left out, and few others stay.

    Before a join that shuffles both sides this spares most rows without a partner the way; the join decides.
    """
    (key,) = keys.columns
    words = min(WORDS, 1 << (keys.count() // 4).bit_length())
    place = F.xxhash64(key)
    word, bit = F.shiftright(place, 6).bitwiseAND(F.lit(words - 1)), place.bitwiseAND(F.lit(63)).cast("int")
    table = keys.groupBy(word.alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__bits"))
    rows = rows.withColumn("__word", word).join(F.broadcast(table), "__word")
    return rows.filter(F.call_function("getbit", "__bits", bit) == 1).drop("__word", "__bits")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: a worker then holds few long texts, and what is made of them, at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
