"""Registration, the given tables, and the roles they play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Each role is one SELECT over whole given tables; Spark and the oracle run the same text.
ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "run_log": (
        ("events",),
        """select event_id as log_id, user_id as job_id, ts as created_at,
          case event_type when 'purchase' then 'completed' when 'signup' then 'success' when 'error' then 'failed'
               when 'click' then 'running' else 'pending' end as status,
          cast(floor(value * 1000) as bigint) as duration_ms,
          case when event_type = 'error' then props end as error_message,
          case when event_type in ('purchase', 'signup', 'error') then ts end as completed_at
        from events""",
    ),
    "jobs": (
        ("customer",),
        """select c_custkey as job_id, c_name as name, cast(c_nationkey as bigint) as network_id,
          c_mktsegment as dest_table,
          case when c_acctbal < 0 then 'failed' when c_acctbal < 3000 then 'running' else 'completed' end as status
        from customer""",
    ),
    "networks": (
        ("nation", "region"),
        """select cast(n_nationkey as bigint) as network_id, n_name as network_name, lower(n_name) as agent_name,
          concat('10.0.', cast(n_regionkey as varchar(20)), '.', cast(n_nationkey as varchar(20))) as ip_address,
          case when n_regionkey = 1 then 'offline' else 'online' end as status,
          case when n_regionkey = 2 then cast(null as double) else cast(n_nationkey as double) end as cpu_usage,
          case when n_regionkey = 3 then null else r_name end as notes,
          case when n_regionkey = 4 then 'file' else 'database' end as source_type,
          case when n_regionkey = 4 then null else concat('db', cast(n_nationkey as varchar(20))) end as db_host
        from nation join region on n_regionkey = r_regionkey""",
    ),
    "audit": (
        ("events",),
        """select event_id as id, concat('user', cast(user_id as varchar(20))) as username,
          case event_type when 'signup' then 'CREATE' when 'purchase' then 'UPDATE' when 'error' then 'DELETE'
               when 'click' then 'LOGIN' else 'VIEW' end as action,
          case when value < 10 then null when value < 30 then 'JOB' else 'NETWORK' end as entity,
          case when value < 20 then null else concat('Agent: node', cast(user_id as varchar(20)), ' ', props) end
            as details,
          ts as created_at
        from events""",
    ),
    "ran_jobs": (
        ("customer", "events"),
        """select c_custkey as job_id, c_name as name,
          case when c_acctbal < 0 then 'failed' when c_acctbal < 3000 then 'running' else 'completed' end as status,
          last_run
        from customer left join (select user_id, max(ts) as last_run from events group by user_id) e
          on c_custkey = user_id""",
    ),
    "orders_target": (
        ("orders",),
        "select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus as legacy_flag from orders",
    ),
    # Several rows per key, keys the target lacks, rows without a key, NULLs that must overwrite.
    "orders_feed": (
        ("lineitem",),
        """select case when l_returnflag = 'R' then -1 - l_orderkey when l_quantity > 48 then null else l_orderkey end
            as o_orderkey,
          l_extendedprice as o_totalprice,
          case when l_discount > 0.08 then null else l_returnflag end as o_orderpriority,
          l_shipdate as shipped_at, l_linenumber as line
        from lineitem""",
    ),
    "batches": (
        ("events",),
        """select user_id as log_id, ts,
          case when event_type = 'purchase' then 'completed' when event_type = 'signup' then 'success'
               when event_type = 'error' and value > 200 then 'failed' else 'running' end as status,
          cast(floor(value) as bigint) as record_count,
          case when event_type = 'error' and value > 250 then props else '' end as error,
          (event_type in ('click', 'view', 'error')) as partial,
          case when value > 5 then props end as sample
        from events""",
    ),
    "heartbeats": (
        ("events",),
        """select concat('node', cast(user_id as varchar(20))) as agent_name, ts,
          case event_type when 'error' then 'offline' else 'online' end as status,
          concat('10.0.0.', cast(user_id as varchar(20))) as ip_address,
          case when event_type in ('click', 'view') then value end as cpu_usage,
          case when event_type = 'signup' then cast(floor(value * 100) as bigint) end as memory_total,
          case when event_type = 'purchase' then props end as version
        from events""",
    ),
    "documents_held": (
        ("documents",),
        """select concat(source, '/', cast(doc_id as varchar(20)), '.txt') as key, n_chars as size, doc_id as modified
        from documents""",
    ),
    "documents_mirrored": (
        ("documents", "labels"),
        """select concat(source, '/', cast(d.doc_id as varchar(20)), '.txt') as key, n_chars + toxic as size,
          case when quality = 0 then d.doc_id - 1 else d.doc_id end as modified
        from documents d join labels l on d.doc_id = l.doc_id""",
    ),
}


def role(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tables, sql = ROLES[name]
    for t in tables:
        table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def with_roles(*names: str) -> str:
    """The roles as common table expressions, to put before an oracle's SELECT."""
    return "with " + ", ".join(f"{n} as ({ROLES[n][1]})" for n in names) + " "
