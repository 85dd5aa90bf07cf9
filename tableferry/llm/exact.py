"""Exact deduplication by skew-safe combining: within tasks, within salted digest groups, then over the salts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm.store import staged

# A digest that covers more than one row in this many is salted; there can be no more such digests than that.
HOT_SHARE = 1024
SALTS = 64


def normalised(text: Column) -> Column:
    """The text that is compared: each run of ASCII white space is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(
    spark: SparkSession, docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Copies are found in three steps, and each compares the whole text, since the text is part of every grouping key:
    inside a task (the map side of the aggregate), inside (digest, salt), and over the salts of a digest. Only digests
    that cover more than 1/1024 of all rows get more than one salt: there are at most 1024 of them, so their list may be
    broadcast, and only their winners travel a second time. Every other text is shuffled once, and rows are never
    gathered: a group is a minimum and a count.

    Null and empty text are equal. ``keep_id`` is the smallest doc_id that is not null, or null if the group has none.
    Rows that repeat a doc_id together with its text share their group and mark; ``drop_copies`` leaves one of them.
    Two texts under one digest (a test forces this) stay apart. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"))
    ids = staged(spark, rows.select("doc_id", "digest", sha256(F.col("norm")).alias("text_sha256")), "digests")
    hot = (
        ids.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > ids.count() / HOT_SHARE)
        .select("digest", F.lit(salts).alias("salts"))
    )
    spread = rows.join(F.broadcast(hot), "digest", "left")
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1)))
    salted = (
        spread.groupBy("digest", salt.alias("salt"), F.col("salts").isNotNull().alias("is_hot"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        # A text of one salt has met all its copies here, so it need not travel on.
        .select("digest", "is_hot", F.when(F.col("is_hot"), F.col("norm")).alias("norm"), "keep_id", "n")
    )
    salted = staged(spark, salted, "salted-groups")
    over_salts = (
        salted.filter("is_hot").groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    )
    groups = salted.filter("not is_hot").unionByName(over_salts, allowMissingColumns=True)
    groups = staged(spark, groups.select("digest", "keep_id", "n"), "exact-groups")
    return _members(spark, rows, ids, groups)


def _members(spark: SparkSession, rows: DataFrame, ids: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its group. A digest names one text, except after a collision; then rows are joined by text too."""

    def out(joined: DataFrame) -> DataFrame:
        keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        return joined.select(
            "doc_id",
            keep.alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(keep).alias("kept"),
            "text_sha256",
        )

    shared = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    repeated = groups.filter("n > 1")
    if shared.isEmpty():
        return out(ids.join(repeated, "digest", "left"))
    shared = staged(spark, shared, "shared-digests")
    apart = rows.join(shared, "digest", "left_semi").withColumn("text_sha256", sha256(F.col("norm")))
    by_text = apart.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return out(ids.join(shared, "digest", "left_anti").join(repeated, "digest", "left")).unionByName(
        out(apart.join(by_text, "norm"))
    )


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts."""
    kept = exact_groups(spark, docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    marked = docs.withColumn("__text_sha", sha256(normalised(F.col("text"))))
    stays = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_sha") == F.col("__sha"))
    return marked.join(kept, stays, "left_semi").dropDuplicates(["doc_id", "__text_sha"]).drop("__text_sha")


ORACLE = """
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents
)
select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
from t
"""
