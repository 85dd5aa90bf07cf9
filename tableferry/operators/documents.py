"""Insert and upsert of documents whose fields may be absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.functions.names import quoted


def to_document(json: Column) -> Column:
    """A JSON object as a map from field to JSON text.

    A field that is absent has no entry; one that is JSON null has the text
    ``null``. So presence survives, and the values can be compared and shuffled.
    """
    fields = F.try_parse_json(json).try_cast("map<string,variant>")
    return F.transform_values(fields, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def document_field(doc: Column, field: str) -> Column:
    """A scalar field as text; NULL when absent or JSON null."""
    return F.try_variant_get(F.try_parse_json(doc[field]), "$", "string")


def document_insert(target: DataFrame, docs: DataFrame) -> DataFrame:
    return target.unionByName(docs, allowMissingColumns=True)


def document_upsert(
    target: DataFrame,
    source: DataFrame,
    key_field: str,
    order_by: Sequence[str],
    doc: str = "doc",
    target_order: Sequence[str] = (),
) -> DataFrame:
    """Merge documents on one field; only fields present in the incoming document change.

    Both inputs carry documents as maps (see ``to_document``) in column ``doc``;
    ``source`` also has the ``order_by`` columns. Incoming documents of one key
    apply in that order, so later fields win; an incoming document without the
    key field is skipped. Of target documents that share a key only the first by
    ``target_order`` (then by content) changes, all others stay as they are, as
    do those without the key field. Keys are compared as JSON text, so the
    number 1 and the text "1" are two keys. Result: ``key`` and ``doc``.

    Only incoming documents are taken apart: repeated documents of a heavy key
    shrink to one value per field before anything is shuffled. The target is
    joined whole, once, and a heavy key on its side is split by adaptive execution.
    """
    key = quoted(doc)[key_field]
    # Documents that tie on the order still apply one after the other, as wholes.
    rank = F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(order_by)], F.xxhash64(F.to_json(quoted(doc))).alias("tie"))
    fields = source.filter(key.isNotNull()).select(key.alias("key"), rank.alias("rank"), F.explode(quoted(doc)).alias("field", "value"))
    last = fields.groupBy("key", "field").agg(F.max_by("value", F.struct("rank", "value")).alias("value"))
    patches = last.groupBy("key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("__patch")
    )
    place = F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(target_order)], F.xxhash64(F.to_json(quoted(doc))).alias("tie"))
    held = target.select(key.alias("key"), place.alias("__place"), quoted(doc).alias(doc))
    keyed = held.filter(F.col("key").isNotNull())
    first = keyed.groupBy("key").agg(F.min("__place").alias("__first"))
    changes = patches.join(first, "key", "left")
    joined = keyed.join(changes, "key", "left")
    kept = F.map_filter(quoted(doc), lambda name, _: ~F.map_contains_key(F.col("__patch"), name))
    hit = F.col("__patch").isNotNull() & (F.col("__place") == F.col("__first"))
    merged = joined.select("key", F.when(hit, F.map_concat(kept, "__patch")).otherwise(quoted(doc)).alias(doc))
    fresh = changes.filter(F.col("__first").isNull()).select("key", F.col("__patch").alias(doc))
    unkeyed = held.filter(F.col("key").isNull()).select("key", quoted(doc).alias(doc))
    return merged.unionByName(fresh).unionByName(unkeyed)


def document_upsert_counts(target: DataFrame, source: DataFrame, key_field: str, doc: str = "doc") -> DataFrame:
    """How many incoming documents were written and how many lacked the key field."""
    has_key = quoted(doc)[key_field].isNotNull()
    return source.agg(
        F.count_if(has_key).cast("bigint").alias("upserted"),
        F.count_if(has_key.isNull() | ~has_key).cast("bigint").alias("skipped"),
    )
