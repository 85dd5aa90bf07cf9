"""Mirrors of object trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableferry.operators import mirror
from tableferry.plans.catalog.registry import query, role, table, with_roles
from tableferry.session import scratch_dir
from tableferry.streaming.watch import watch_and_mirror

PLANNED = f"""{with_roles("documents_held", "documents_mirrored")}
select s.key, s.size, s.modified,
  case when t.key is null then 'new' when s.size <> t.size then 'size' when s.modified > t.modified then 'newer'
       else 'skip' end as action
from documents_held s left join documents_mirrored t on s.key = t.key"""


@query("mirror_plan", PLANNED)
def mirror_plan(spark, sf):
    return mirror.mirror_plan(role(spark, sf, "documents_held"), role(spark, sf, "documents_mirrored"))


@query(
    "mirror_stats",
    f"""select count(*) filter (action <> 'skip') as objects_copied, count(*) filter (action = 'skip') as objects_skipped,
      cast(coalesce(sum(size) filter (action <> 'skip'), 0) as bigint) as bytes_copied, 0::bigint as errors
    from ({PLANNED})""",
)
def mirror_stats(spark, sf):
    plan = mirror_plan(spark, sf)
    done = plan.select(
        "key",
        "action",
        F.when(F.col("action") == "skip", 0).otherwise(F.col("size")).alias("bytes"),
        F.lit(None).cast("string").alias("error"),
    )
    return mirror.mirror_stats(done)


@query("mirror_copy", "select doc_id, text, lang from documents")
def mirror_copy(spark, sf):
    """Copy a tree twice: the copy holds the table, and the second pass copies nothing."""
    source, target = scratch_dir(spark, "tree"), scratch_dir(spark, "copy")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    docs.write.partitionBy("lang").parquet(source)
    mirror.mirror(spark, source, target, "*.parquet")
    again = mirror.mirror_stats(mirror.mirror(spark, source, target, "*.parquet")).first()
    if again["objects_copied"] or again["errors"]:
        raise AssertionError(f"a second pass had something to do: {again}")
    return spark.read.parquet(target).select("doc_id", "text", "lang")


@query(
    "mirror_watch",
    "select 'documents' as tree, doc_id as id from documents union all select 'pages', page_id from pages",
)
def mirror_watch(spark, sf):
    """A watch that is stopped and started again copies the objects that came in between, and only those."""
    source, target, progress = (scratch_dir(spark, n) for n in ("tree", "copy", "progress"))
    for tree, key in (("documents", "doc_id"), ("pages", "page_id")):
        table(spark, sf, tree).selectExpr(f"{key} as id").write.parquet(f"{source}/tree={tree}")
        watch_and_mirror(spark, source, target, progress, "*.parquet", availableNow=True).awaitTermination()
    return spark.read.parquet(target).select("tree", "id")


@query("mirror_all_names", "select doc_id, text from documents")
def mirror_all_names(spark, sf):
    """A tree whose folders and files have names that Spark's own readers pass over arrives whole."""
    source, target = scratch_dir(spark, "tree"), scratch_dir(spark, "copy")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("_hidden."), "lang").alias("_lang"))
    docs.write.partitionBy("_lang").parquet(f"{source}/.tree")
    outcome = mirror.mirror_stats(mirror.mirror(spark, source, target)).first()
    if outcome["errors"]:
        raise AssertionError(f"copies failed: {outcome}")
    return spark.read.parquet(f"{target}/.tree").select("doc_id", "text")
