"""A directory of pages: a sorted copy in ranges with counts, so that any page is looked up where it lies."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.session import read_text, write_text

ROWS_A_RANGE = 1_000_000
# Spark's row ids hold the partition above, and the place in it below, this bit.
PLACE_BITS = 33


class PageDirectory:
    """Pages of a table in a fixed order, kept in a folder.

    ``build`` sorts the table once, range by range in different tasks, and notes how many rows come before each range. A page
    then reads the ranges it touches, and of those the row groups that hold its places: page a million costs what page one does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, df: DataFrame, order: Sequence[str | Column], rows_a_range: int = ROWS_A_RANGE) -> PageDirectory:
        """Sort ``df`` by ``order``, which must name every row's place: rows that tie may swap between builds."""
        clash = {"page_range", "page_place"} & {c.lower() for c in df.columns}
        if clash:
            raise ValueError(f"columns {sorted(clash)} are those of the directory")
        ranges = max(1, -(-df.count() // rows_a_range))
        rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        rows = rows.select("*", F.monotonically_increasing_id().alias("page_place"))
        rows = rows.withColumn("page_range", F.shiftright("page_place", PLACE_BITS).cast("int"))
        rows = rows.withColumn("page_place", F.col("page_place").bitwiseAND((1 << PLACE_BITS) - 1))
        write_text(self.spark, f"{self.path}/schema.json", rows.schema.json())
        rows.write.partitionBy("page_range").parquet(f"{self.path}/rows")
        counts = self._rows().groupBy("page_range").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.orderBy("page_range").rowsBetween(Window.unboundedPreceding, -1))
        counts.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{self.path}/ranges")
        return self

    def _rows(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(read_text(self.spark, f"{self.path}/schema.json")))
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def total(self) -> int:
        return int(self.spark.read.parquet(f"{self.path}/ranges").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def page(self, number: int = 1, size: int = 10) -> DataFrame:
        """One page in order. Numbers below 1 fall back to the first page and to ten rows; past the end there are no rows."""
        first = (max(number, 1) - 1) * (size if size >= 1 else 10)
        last = first + (size if size >= 1 else 10)
        touched = self.spark.read.parquet(f"{self.path}/ranges").filter((F.col("before") < last) & (F.col("before") + F.col("n") > first))
        wanted = F.lit(False)
        for r in touched.collect():
            inside = F.col("page_place").between(first - r["before"], last - 1 - r["before"])
            wanted = wanted | ((F.col("page_range") == r["page_range"]) & inside)
        return self._rows().filter(wanted).orderBy("page_range", "page_place").drop("page_range", "page_place")
