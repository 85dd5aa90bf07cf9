"""Extraction by SQL, discovery, documents, key spaces and user transforms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tableferry.operators.keys import next_key
from tableferry.operators.runs import checkpoint_max
from tableferry.operators.tables import BucketedTable, VersionedTable
from tableferry.operators.transforms import run_transform
from tableferry.plans.catalog.registry import query, table
from tableferry.plans.run import bulk_sync, run
from tableferry.session import scratch_dir
from tableferry.sources import documents, keyspace, sql
from tableferry.spec import Endpoint, Rule, SyncSpec

ROLLUP = """
select n_name, o_orderstatus, count(*) as orders,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total_price
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
group by n_name, o_orderstatus"""


@query("sql_extract_rollup", ROLLUP)
def sql_extract_rollup(spark, sf):
    sql.register_tables(spark, {t: f"{sf}/{t}.parquet" for t in ("orders", "customer", "nation")})
    return sql.sql_extract(spark, ROLLUP)


@query(
    "incremental_extract",
    "select o_orderkey, o_totalprice, o_orderdate from orders where o_orderdate > timestamp '1998-06-30 00:00:00'",
)
def incremental_extract(spark, sf):
    sql.register_tables(spark, {"orders": f"{sf}/orders.parquet"})
    text = "select o_orderkey, o_totalprice, o_orderdate from orders where o_orderdate > {{CA_Pointer}}"
    return sql.incremental_extract(spark, text, datetime(1998, 6, 30))


@query(
    "query_metadata",
    "select position, name, type, row_count from (values (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), "
    "(3, 'o_orderstatus', 'string'), (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp_ntz'), "
    "(6, 'o_orderpriority', 'string')) c(position, name, type), (select count(*) as row_count from orders)",
)
def query_metadata(spark, sf):
    return sql.query_metadata(table(spark, sf, "orders"))


@query("checkpoint_max", "select max(o_orderkey) as checkpoint from orders")
def checkpoint_typed(spark, sf):
    return checkpoint_max(table(spark, sf, "orders"), "o_orderkey")


@query("checkpoint_max_lexical", "select max(cast(o_orderkey as varchar)) as checkpoint from orders")
def checkpoint_lexical(spark, sf):
    return checkpoint_max(table(spark, sf, "orders"), "o_orderkey", "lexicographic")


COLUMNS = {
    "region": "r_regionkey, r_name",
    "nation": "n_nationkey, n_name, n_regionkey",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "supplier": "s_suppkey, s_name, s_nationkey, s_acctbal",
    "part": "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice",
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "lineitem": "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate",
    "events": "event_id, ts, user_id, event_type, value, props",
    "documents": "doc_id, text, lang, source, n_chars",
    "embeddings": "vec_id, embedding, label",
    "pages": "page_id, url, html",
    "benchmark": "item_id, text",
    "labels": "doc_id, quality, toxic",
    "conversations": "conv_id, turn, role, text",
}


@query(
    "table_discovery",
    " union all ".join(
        f"select 'default' as schema, '{t}' as table_name, count(*) as row_count, '{c}' as columns from {t}"
        for t, c in COLUMNS.items()
    ),
)
def table_discovery(spark, sf):
    return sql.discover(spark, {t: table(spark, sf, t) for t in COLUMNS})


@query(
    "table_discovery_joined",
    """with docs as (select case when n_chars > 3000 then 'long' else 'short' end as schema, source as table_name, lang
        from documents),
      tables as (select distinct schema, table_name from docs),
      estimates as (select schema, table_name, count(*) as n from docs where lang = 'en' group by 1, 2),
      cols as (select distinct schema, table_name, lang as column_name,
                 case lang when 'fr' then 1 when 'es' then 2 when 'en' then 3 else 4 end as position from docs),
      lists as (select schema, table_name, string_agg(column_name, ', ' order by position) as columns from cols group by 1, 2)
    select schema, table_name, coalesce(n, 0) as row_count, coalesce(columns, '') as columns
    from tables left join estimates using (schema, table_name) left join lists using (schema, table_name)""",
)
def table_discovery_joined(spark, sf):
    """Tables of one name in two schemas are two tables."""
    schema = F.when(F.col("n_chars") > 3000, "long").otherwise("short")
    docs = table(spark, sf, "documents").select(schema.alias("schema"), F.col("source").alias("table_name"), "lang")
    estimates = docs.filter("lang = 'en'").groupBy("schema", "table_name").agg(F.count(F.lit(1)).alias("row_count"))
    position = F.expr("case lang when 'fr' then 1 when 'es' then 2 when 'en' then 3 else 4 end")
    columns = docs.select("schema", "table_name", position.alias("position"), F.col("lang").alias("column_name")).distinct()
    return sql.join_discovery(docs.select("schema", "table_name").distinct(), estimates, columns)


@query(
    "bulk_sync",
    " union all ".join(
        f"select 'copy_{t}' as table_name, 'completed' as status, count(*) as row_count, "
        f"cast(null as varchar) as error from {t}"
        for t in ("region", "nation", "supplier", "customer", "orders")
    ),
)
def bulk(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("region", "nation", "supplier", "customer", "orders")}
    return bulk_sync(spark, tables, scratch_dir(spark, "bulk"), prefix="copy_")


@query(
    "next_key",
    " union all ".join(
        f"select '{t}' as table_name, cast(coalesce(max({k}), 0) + 1 as bigint) as next_key, "
        f"cast(null as varchar) as error from {t}"
        for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey"))
    )
    + " union all select 'supplier', null, 'no column id' from (select count(*) from supplier)",
)
def next_keys(spark, sf):
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "supplier": "id"}
    return next_key(spark, {t: (table(spark, sf, t), k) for t, k in keys.items()})


@query(
    "transform_hook",
    """select o_custkey, count(*) as orders, max(o_totalprice) as top_price from orders
    where o_orderstatus = 'F' group by o_custkey having count(*) >= 3""",
)
def transform_hook(spark, sf):
    def finished(query, frames):
        return query("select o_custkey, o_totalprice from orders where o_orderstatus = :status", status="F")

    def busy(query, frames):
        return query(
            "select o_custkey, count(*) as orders, max(o_totalprice) as top_price from finished "
            "group by o_custkey having count(*) >= :least",
            least=3,
        )

    return run_transform(spark, [("finished", finished), ("busy", busy)], {"orders": table(spark, sf, "orders")})


EVENT_DOCS = """select event_id, user_id, event_type, value, cast(json_extract(props, '$.k') as bigint) as k from events"""


def event_documents(spark, sf):
    """Events as documents with a nested object."""
    events = table(spark, sf, "events")
    return events.select(
        "event_id", "user_id", "event_type", "value", F.from_json("props", "struct<k:bigint>").alias("props")
    )


@query(
    "document_filter",
    f"""select event_id, event_type, k from ({EVENT_DOCS})
    where (event_type in ('click', 'error') or value >= 100) and k > 50 and k <> 77 and user_id not in (1, 2)""",
)
def document_filter(spark, sf):
    wanted = {
        "$or": [{"event_type": {"$in": ["click", "error"]}}, {"value": {"$gte": 100}}],
        "props": {"k": {"$gt": 50, "$ne": 77}},
        "user_id": {"$nin": [1, 2]},
        "missing": None,
    }
    found = documents.find(event_documents(spark, sf), wanted)
    return found.select("event_id", "event_type", F.col("props.k").alias("k"))


@query(
    "document_aggregate",
    f"""select event_type as _id, count(*) as n, max(k) as top_k, min(value) as least from ({EVENT_DOCS})
    where value > 10 group by event_type order by n desc, event_type limit 3""",
)
def document_aggregate(spark, sf):
    return documents.aggregate(
        event_documents(spark, sf),
        [
            {"$match": {"value": {"$gt": 10}}},
            {"$project": {"event_type": 1, "k": "$props.k", "value": 1}},
            {"$group": {"_id": "$event_type", "n": {"$sum": 1}, "top_k": {"$max": "$k"}, "least": {"$min": "$value"}}},
            {"$sort": {"n": -1, "_id": 1}},
            {"$limit": 3},
        ],
    )


def key_dump(spark, sf):
    """A key-value dump with every value type, from four tables."""
    customers = table(spark, sf, "customer")
    parts = table(spark, sf, "part")

    def rows(df, key, kind, value, ttl):
        return df.select(
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("key"),
            F.lit(kind).alias("type"),
            value.alias("value"),
            F.lit(float(ttl)).alias("ttl"),
        )

    hashes = F.to_json(F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")))
    lists = F.to_json(F.array("p_type", "p_brand", "p_name"))
    scores = F.to_json(F.array(*[F.struct(F.col(c).alias("member"), s.alias("score")) for c, s in (
        ("p_name", F.col("p_retailprice")), ("p_brand", F.col("p_size").cast("double")))]))
    return (
        rows(customers, "c_custkey", "hash", hashes, -1)
        .unionByName(rows(parts, "p_partkey", "list", lists, 60))
        .unionByName(rows(parts, "p_partkey", "set", lists, 90))
        .unionByName(rows(parts, "p_partkey", "zset", scores, -1))
        .unionByName(rows(table(spark, sf, "supplier"), "s_suppkey", "string", F.col("s_name"), 3600))
    )


@query(
    "keyspace_scan",
    """select concat('hash:', c_custkey) as key, 'hash' as type, -1.0::double as ttl, null as string_value,
      c_mktsegment as segment, null as items, null as members from customer
    union all select concat('list:', p_partkey), 'list', 60.0, null, null, concat_ws('|', p_type, p_brand, p_name), null
      from part
    union all select concat('set:', p_partkey), 'set', 90.0, null, null,
      array_to_string(list_sort([p_type, p_brand, p_name]), '|'), null from part
    union all select concat('zset:', p_partkey), 'zset', -1.0, null, null, null,
      case when p_size <= p_retailprice then concat(p_brand, '|', p_name) else concat(p_name, '|', p_brand) end from part
    union all select concat('string:', s_suppkey), 'string', 3600.0, s_name, null, null, null from supplier""",
)
def keyspace_scan(spark, sf):
    return keyspace.scan_keys(key_dump(spark, sf), "*:*").select(
        "key",
        "type",
        "ttl",
        "string_value",
        F.col("hash_value")["segment"].alias("segment"),
        F.array_join("list_value", "|").alias("items"),
        F.array_join(F.col("zset_value.member"), "|").alias("members"),
    )


@query(
    "hash_flatten",
    "select concat('hash:', c_custkey) as _key, c_name as name, c_mktsegment as segment from customer",
)
def hash_flatten(spark, sf):
    return keyspace.hash_flatten(key_dump(spark, sf), "hash:*")


@query(
    "hash_flatten_rows",
    "select concat('conv:', conv_id) as _key, "
    + ", ".join(f"max(case when turn % 16 = {i} then text end) as t{i}" for i in range(16))
    + " from conversations group by conv_id",
)
def hash_flatten_rows(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.concat(F.lit("conv:"), F.col("conv_id")).alias("key"),
        F.concat(F.lit("t"), F.col("turn") % 16).alias("field"),
        F.col("text").alias("value"),
    )
    return keyspace.hash_flatten_rows(rows, [f"t{i}" for i in range(16)])


@query(
    "run_all_rules",
    """select 'all_orders' as rule, 'completed' as status, count(*) as record_count, count(*) as inserted,
      0 as updated, cast(max(o_orderkey) as varchar) as checkpoint from orders
    union all select 'customers', 'completed', count(*), count(*), 0, null from customer""",
)
def run_all_rules(spark, sf):
    sql.register_tables(spark, {t: f"{sf}/{t}.parquet" for t in ("orders", "customer")})
    spec = SyncSpec(
        "nightly",
        Endpoint(),
        Endpoint(path=scratch_dir(spark, "target")),
        (
            Rule(
                "all_orders",
                "select * from orders where o_orderkey > {{ca_pointer}}",
                key="o_orderkey",
            ),
            Rule("customers", "select * from customer", key="c_custkey"),
        ),
        checkpoint_column="o_orderkey",
    )
    events = run(spark, spec, scratch_dir(spark, "state"), datetime(2024, 1, 31), {"all_orders": -1})
    return events.select("rule", "status", "record_count", "inserted", "updated", "checkpoint")



@query("incremental_two_runs", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def incremental_two_runs(spark, sf):
    """The older half by one run, then all orders by a second that goes on from the run log: as one full run."""
    orders = table(spark, sf, "orders")
    middle = orders.agg(F.percentile_approx(F.unix_micros(F.col("o_orderdate").cast("timestamp")), 0.5)).first()[0]
    older = F.unix_micros(F.col("o_orderdate").cast("timestamp")) <= middle
    target, state = scratch_dir(spark, "target"), scratch_dir(spark, "state")
    rule = Rule("orders_copy", "select * from growing_orders where o_orderdate > {{ca_pointer}}", key="o_orderkey")
    spec = SyncSpec("halves", Endpoint(), Endpoint(path=target), (rule,), checkpoint_column="o_orderdate")
    for day, rows in ((1, orders.filter(older)), (2, orders)):
        rows.createOrReplaceTempView("growing_orders")
        event = run(spark, spec, state, datetime(2024, 1, day)).first()
        if event["status"] != "completed":
            raise RuntimeError(event["error"])
    return VersionedTable(spark, f"{target}/orders_copy").read()


def _run_once(spark, source: Endpoint, rule: Rule) -> str:
    """One run of one rule; the folder of its target."""
    target = scratch_dir(spark, "target")
    spec = SyncSpec("once", source, Endpoint(path=target), (rule,))
    event = run(spark, spec, scratch_dir(spark, "state"), datetime(2024, 1, 31)).first()
    if event["status"] != "completed":
        raise RuntimeError(event["error"])
    return f"{target}/{rule.target_table}"


@query("run_file_source", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer")
def run_file_source(spark, sf):
    """All files of an export, however many tasks wrote it."""
    path = scratch_dir(spark, "csv")
    table(spark, sf, "customer").withColumnRenamed("c_name", " c_name ").write.csv(path, header=True)
    rule = Rule("customers", "*.csv", key="c_custkey")
    return VersionedTable(spark, _run_once(spark, Endpoint("file", path=path, options={"pick": "all"}), rule)).read()


@query(
    "run_api_source",
    "select o_orderkey as request_id, o_custkey as id, o_totalprice as price from orders where o_orderstatus <> 'P'",
)
def run_api_source(spark, sf):
    """One landed response per order; those of pending orders failed."""
    path = scratch_dir(spark, "responses")
    body = F.to_json(F.struct(F.array(F.struct(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"))).alias("data")))
    landed = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderstatus") == "P", 500).otherwise(200).alias("status"),
        F.lit(1).alias("attempt"), body.alias("body"),
    )
    landed.write.parquet(path)
    rule = Rule("prices", schema="id bigint, price double", key="request_id", buckets=8)
    return BucketedTable(spark, _run_once(spark, Endpoint("api", path=path), rule), "request_id", 8).read()


@query("run_document_source", "select event_id, event_type, value from events where event_type = 'click' and value > 5")
def run_document_source(spark, sf):
    wanted = '{"event_type": "click", "value": {"$gt": 5}}'
    source = Endpoint("mongodb", path=f"{sf}/events.parquet")
    rows = VersionedTable(spark, _run_once(spark, source, Rule("clicks", wanted, key="event_id"))).read()
    return rows.select("event_id", "event_type", "value")


@query("run_keyspace_source", "select concat('string:', s_suppkey) as key, s_name as string_value from supplier")
def run_keyspace_source(spark, sf):
    path = scratch_dir(spark, "dump")
    key_dump(spark, sf).write.parquet(path)
    rows = VersionedTable(spark, _run_once(spark, Endpoint("redis", path=path), Rule("names", "string:*", key="key"))).read()
    return rows.select("key", "string_value")


@query("run_mirror_source", "select doc_id, lang from documents")
def run_mirror_source(spark, sf):
    path = scratch_dir(spark, "bucket")
    table(spark, sf, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    return spark.read.parquet(_run_once(spark, Endpoint("minio", path=path), Rule("copy", "*.parquet"))).select("doc_id", "lang")
