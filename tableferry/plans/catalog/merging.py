"""Deduplication, merges and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableferry.operators import documents
from tableferry.operators.compare import compare, compare_summary
from tableferry.operators.dedupe import latest_per_key
from tableferry.operators.merge import insert_skip, merge_counts, project_to, staged_upsert, upsert
from tableferry.operators.tables import BucketedTable, VersionedTable, truncate_load
from tableferry.plans.catalog.registry import query, role, table, with_roles
from tableferry.plans.hooks import run_hooks
from tableferry.session import scratch_dir

ORDER = ["shipped_at", "line"]
# The latest row per key, and the first; every column takes part, so there are no ties.
LATEST = """latest as (select * exclude (n) from (select *, row_number() over (partition by o_orderkey
  order by shipped_at desc, line desc, o_totalprice desc, o_orderpriority desc nulls last) as n
  from orders_feed where o_orderkey is not null) where n = 1)"""
FIRST = """earliest as (select * exclude (n) from (select *, row_number() over (partition by o_orderkey
  order by shipped_at, line, o_totalprice, o_orderpriority nulls first) as n
  from orders_feed where o_orderkey is not null) where n = 1)"""
MERGED = f"""{with_roles("orders_target", "orders_feed")}, {LATEST}
select coalesce(t.o_orderkey, s.o_orderkey) as o_orderkey,
  case when s.o_orderkey is not null then s.o_totalprice else t.o_totalprice end as o_totalprice,
  case when s.o_orderkey is not null then s.o_orderpriority else t.o_orderpriority end as o_orderpriority,
  t.legacy_flag, s.shipped_at, s.line
from orders_target t full join latest s on t.o_orderkey = s.o_orderkey
union all
select o_orderkey, o_totalprice, o_orderpriority, null, shipped_at, line from orders_feed where o_orderkey is null"""


def inputs(spark, sf):
    return role(spark, sf, "orders_target"), role(spark, sf, "orders_feed")


@query("upsert_orders", MERGED)
def upsert_orders(spark, sf):
    return upsert(*inputs(spark, sf), "o_orderkey", ORDER, target_unique=True)


@query("upsert_orders_any_target", MERGED)
def upsert_orders_any_target(spark, sf):
    return upsert(*inputs(spark, sf), "o_orderkey", ORDER)


@query("staged_merge_orders", MERGED)
def staged_merge_orders(spark, sf):
    return staged_upsert(*inputs(spark, sf), "o_orderkey", ORDER)


@query(
    "upsert_counts",
    f"""{with_roles("orders_target", "orders_feed")}, {LATEST}
    select count(*) filter (t.o_orderkey is null) + (select count(*) from orders_feed where o_orderkey is null) as inserted,
      count(*) filter (t.o_orderkey is not null and s.o_orderkey is not null) as updated,
      count(*) filter (s.o_orderkey is null) as kept
    from orders_target t full join latest s on t.o_orderkey = s.o_orderkey""",
)
def upsert_counts(spark, sf):
    return merge_counts(upsert(*inputs(spark, sf), "o_orderkey", ORDER, target_unique=True, with_action=True))


@query("versioned_upsert", MERGED)
def versioned_upsert(spark, sf):
    target, feed = inputs(spark, sf)
    orders = VersionedTable(spark, scratch_dir(spark, "versions"))
    orders.commit(target)
    return orders.upsert(feed, "o_orderkey", ORDER, tag="feed-1")


@query("bucketed_upsert", MERGED)
def bucketed_upsert(spark, sf):
    target, feed = inputs(spark, sf)
    orders = BucketedTable(spark, scratch_dir(spark, "buckets"), "o_orderkey", buckets=16)
    orders.create(target)
    orders.upsert(feed, ORDER)
    return orders.read()


@query(
    "insert_skip_orders",
    f"""{with_roles("orders_target", "orders_feed")}, {FIRST}
    select o_orderkey, o_totalprice, o_orderpriority, legacy_flag, null as shipped_at, null as line from orders_target
    union all select o_orderkey, o_totalprice, o_orderpriority, null, shipped_at, line from earliest
      where o_orderkey not in (select o_orderkey from orders_target)
    union all select o_orderkey, o_totalprice, o_orderpriority, null, shipped_at, line from orders_feed
      where o_orderkey is null""",
)
def insert_skip_orders(spark, sf):
    return insert_skip(*inputs(spark, sf), "o_orderkey", ORDER, target_unique=True)


@query(
    "project_columns",
    "select o_orderpriority, o_orderkey, cast(null as varchar) as absent from orders",
)
def project_columns(spark, sf):
    rows = project_to(table(spark, sf, "orders"), ["o_orderpriority", "o_orderkey", "absent"])
    return rows.withColumn("absent", F.col("absent").cast("string"))


@query("truncate_load", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def truncate(spark, sf):
    path = scratch_dir(spark, "table")
    customers = table(spark, sf, "customer")
    truncate_load(customers.withColumn("c_name", F.lit("old")), path)
    return truncate_load(customers, path)


@query(
    "latest_per_key",
    """select * exclude (n) from (select *, row_number() over (partition by l_orderkey order by l_shipdate desc,
      l_partkey desc, l_suppkey desc, l_linenumber desc, l_quantity desc, l_extendedprice desc, l_discount desc,
      l_tax desc, l_returnflag desc, l_linestatus desc) as n from lineitem) where n = 1""",
)
def latest_lineitem(spark, sf):
    return latest_per_key(table(spark, sf, "lineitem"), "l_orderkey", ["l_shipdate"])


@query(
    "hooked_run",
    "select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice >= 1000 and o_orderstatus <> 'P'",
)
def hooked_run(spark, sf):
    """A hook before the load names the rows to leave out, a hook after it adds a rule; a broken one is passed over."""
    table(spark, sf, "orders").createOrReplaceTempView("hook_orders")
    run_hooks(
        spark.sql,
        [
            "create or replace temporary view hook_loaded as select o_orderkey, o_orderstatus, o_totalprice "
            "from hook_orders where o_totalprice >= 1000",
            "select no_such_column from hook_loaded",
            "create or replace temporary view hook_kept as select * from hook_loaded where o_orderstatus <> 'P'",
        ],
    )
    return spark.table("hook_kept")


COMPARED = f"""{with_roles("orders_target", "orders_feed")},
  s as (select o_orderkey, any_value(o_totalprice) as p, any_value(o_orderpriority) as q, count(*) as n
        from orders_feed group by 1),
  t as (select o_orderkey, o_totalprice as p, o_orderpriority as q, 1 as n from orders_target),
  j as (select s.n as sn, t.n as tn, coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey,
          s.p is distinct from t.p as dp, s.q is distinct from t.q as dq
        from s full join t on s.o_orderkey = t.o_orderkey)
select o_orderkey,
  case when coalesce(sn, 0) > 1 or coalesce(tn, 0) > 1 then 'duplicate_key' when tn is null then 'only_source'
       when sn is null then 'only_target' when dp or dq then 'changed' else 'equal' end as class,
  coalesce(sn, 0) as source_rows, cast(coalesce(tn, 0) as bigint) as target_rows,
  case when sn = 1 and tn = 1 and (dp or dq)
    then concat_ws(', ', case when dp then 'o_totalprice' end, case when dq then 'o_orderpriority' end) end
    as changed_columns
from j"""


@query("compare_tables", COMPARED)
def compare_tables(spark, sf):
    target, feed = inputs(spark, sf)
    return compare(feed, target, "o_orderkey", ["o_totalprice", "o_orderpriority"])


@query("compare_tables_by_value", COMPARED)
def compare_values(spark, sf):
    target, feed = inputs(spark, sf)
    return compare(feed, target, "o_orderkey", ["o_totalprice", "o_orderpriority"], by_value=True)


@query(
    "compare_summary",
    """select class, count(*) as keys from (
      select case when o.o_orderkey is null then 'only_target' when d.doc_id is null then 'only_source'
        when o.o_totalprice is distinct from d.price or o.o_orderstatus is distinct from d.status then 'changed'
        else 'equal' end as class
      from orders o full join (select o_orderkey + (case when o_orderpriority = '1-URGENT' then 1000000000 else 0 end)
          as doc_id, o_totalprice as price,
          case when o_orderpriority = '2-HIGH' then null else o_orderstatus end as status from orders) d
        on o.o_orderkey = d.doc_id) group by class""",
)
def compare_totals(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    moved = table(spark, sf, "orders").selectExpr(
        "o_orderkey + if(o_orderpriority = '1-URGENT', 1000000000, 0) as o_orderkey",
        "o_totalprice",
        "if(o_orderpriority = '2-HIGH', null, o_orderstatus) as o_orderstatus",
    )
    return compare_summary(compare(orders, moved, "o_orderkey"))


@query(
    "document_upsert",
    """with first as (select conv_id, min(turn) as turn from conversations group by 1),
      held as (select c.conv_id, c.role as opened_by, c.turn as opened_at from conversations c
        join first f on c.conv_id = f.conv_id and c.turn = f.turn),
      seen as (select conv_id, arg_max(text, turn) as last_text, max(turn) as last_turn,
        bool_or(role <> 'user') as has_answer from conversations group by 1)
    select conv_id, opened_by, opened_at, last_text, last_turn, has_answer from held join seen using (conv_id)""",
)
def document_upsert(spark, sf):
    turns = table(spark, sf, "conversations")
    first = latest_per_key(turns.withColumn("__back", -F.col("turn")), "conv_id", ["__back"])
    held = first.select(
        documents.to_document(
            F.to_json(F.struct("conv_id", F.col("role").alias("opened_by"), F.col("turn").alias("opened_at")))
        ).alias("doc")
    )
    # A user turn says nothing about an answer, so the field must survive from an earlier document.
    news = turns.select(
        "turn",
        documents.to_document(
            F.to_json(
                F.struct(
                    "conv_id",
                    F.col("text").alias("last_text"),
                    F.col("turn").alias("last_turn"),
                    F.when(F.col("role") != "user", F.lit(True)).alias("answered"),
                )
            )
        ).alias("doc"),
    )
    merged = documents.document_upsert(held, news, "conv_id", ["turn"])

    def field(name):
        return documents.document_field(F.col("doc"), name)

    return merged.select(
        field("conv_id").cast("bigint").alias("conv_id"),
        field("opened_by").alias("opened_by"),
        field("opened_at").cast("bigint").alias("opened_at"),
        field("last_text").alias("last_text"),
        field("last_turn").cast("bigint").alias("last_turn"),
        F.coalesce(field("answered").cast("boolean"), F.lit(False)).alias("has_answer"),
    )


@query(
    "document_upsert_repeated_keys",
    """select conv_id, turn, role, case when turn = min(turn) over (partition by conv_id)
        then max(turn) over (partition by conv_id) end as last_turn from conversations""",
)
def document_upsert_repeated_keys(spark, sf):
    """Every turn is a held document under its conversation's key; only the first of a key takes the change."""
    turns = table(spark, sf, "conversations")
    held = turns.select("turn", documents.to_document(F.to_json(F.struct("conv_id", "turn", "role"))).alias("doc"))
    news = turns.select(
        "turn", documents.to_document(F.to_json(F.struct("conv_id", F.col("turn").alias("last_turn")))).alias("doc")
    )
    merged = documents.document_upsert(held, news, "conv_id", ["turn"], target_order=["turn"])
    numbers = {c: documents.document_field(F.col("doc"), c).cast("bigint") for c in ("conv_id", "turn", "last_turn")}
    return merged.select(
        numbers["conv_id"].alias("conv_id"), numbers["turn"].alias("turn"),
        documents.document_field(F.col("doc"), "role").alias("role"), numbers["last_turn"].alias("last_turn"),
    )


@query(
    "document_insert",
    """select conv_id as id, role as kind, text as body, cast(null as varchar) as lang from conversations
    union all select doc_id, source, text, lang from documents""",
)
def document_insert(spark, sf):
    held = table(spark, sf, "conversations").selectExpr("conv_id as id", "role as kind", "text as body")
    news = table(spark, sf, "documents").selectExpr("doc_id as id", "source as kind", "text as body", "lang")
    return documents.document_insert(held, news)
