import pytest
from plans import plan_of
from pyspark.sql import functions as F

from tableferry.operators.paging import PageDirectory
from tableferry.session import scratch_dir


def test_pages_are_those_of_the_whole_order(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(1000)).alias("id"), (F.col("id") % 7).alias("v"))
    pages = PageDirectory(spark, scratch_dir(spark, "pages")).build(df, [F.desc("v"), "id"], rows_a_range=90)
    want = [tuple(r) for r in df.orderBy(F.desc("v"), "id").collect()]
    assert pages.total() == 1000
    for number, size in ((1, 10), (37, 13), (4, 250), (100, 10), (77, 13), (101, 10), (0, 0), (1, 2000)):
        first, rows = (max(number, 1) - 1) * (size or 10), size or 10
        assert [tuple(r) for r in pages.page(number, size).collect()] == want[first : first + rows]


def test_a_deep_page_reads_the_ranges_it_touches(spark):
    pages = PageDirectory(spark, scratch_dir(spark, "pages")).build(spark.range(5000).withColumnRenamed("id", "k"), ["k"], rows_a_range=100)
    whole = len(pages._rows().inputFiles())
    page = pages.page(451, 10)
    assert [r["k"] for r in page.collect()] == list(range(4500, 4510))
    filters = plan_of(page).split("PartitionFilters: [")[1].split("]")[0]
    assert whole >= 40 and "page_range" in filters


def test_no_rows_and_clashing_names(spark):
    pages = PageDirectory(spark, scratch_dir(spark, "pages")).build(spark.range(0), ["id"])
    assert pages.total() == 0
    with pytest.raises(ValueError):
        PageDirectory(spark, scratch_dir(spark, "pages")).build(spark.range(1).withColumnRenamed("id", "page_place"), ["page_place"])
