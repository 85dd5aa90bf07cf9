"""Searches, pages, joins and figures of the console's views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tableferry.functions import search, status, text
from tableferry.functions.protect import find_tokens, token_hash, token_prefix
from tableferry.operators import analytics
from tableferry.operators.paging import PageDirectory
from tableferry.plans.catalog.registry import query, role, table, with_roles
from tableferry.session import scratch_dir


def _jobs_found(spark, sf):
    jobs = analytics.jobs_with_network(
        role(spark, sf, "jobs"), role(spark, sf, "networks").select("network_id", "network_name")
    )
    return jobs.filter(search.search_groups((["name", "network_name"], "9"), (["dest_table", "status"], "RUN")))


JOBS_SEARCH = f"""{with_roles("jobs", "networks")} select job_id, name, network_name, dest_table, j.status
from jobs j join networks n on j.network_id = n.network_id
where (j.name ilike '%9%' or n.network_name ilike '%9%') and (dest_table ilike '%run%' or j.status ilike '%run%')"""


@query("jobs_search_page", f"{JOBS_SEARCH} order by job_id desc limit 20 offset 20")
def jobs_search_page(spark, sf):
    found = _jobs_found(spark, sf).select("job_id", "name", "network_name", "dest_table", "status")
    return analytics.page(found, 2, 20, F.desc("job_id"))


@query("jobs_search_count", f"select count(*) as total from ({JOBS_SEARCH})")
def jobs_search_count(spark, sf):
    return analytics.total(_jobs_found(spark, sf))


@query(
    "jobs_page_after",
    f"""{with_roles("jobs")}, p as (select job_id from jobs order by job_id desc limit 20)
    select job_id, name from jobs where job_id < (select min(job_id) from p) order by job_id desc limit 20""",
)
def jobs_page_after(spark, sf):
    jobs = role(spark, sf, "jobs").select("job_id", "name")
    last = analytics.page_after(jobs, None, 20, "job_id").agg(F.min("job_id")).first()[0]
    return analytics.page_after(jobs, last, 20, "job_id")


@query(
    "audit_page",
    f"""{with_roles("audit")} select id, username, action, entity, created_at from audit
    where action = 'DELETE' and entity = 'NETWORK' order by id desc limit 10 offset 10""",
)
def audit_page(spark, sf):
    found = role(spark, sf, "audit").filter(search.exact(action="DELETE", entity="NETWORK", username=None))
    return analytics.page(found.select("id", "username", "action", "entity", "created_at"), 2, 10)


@query(
    "jobs_with_network",
    f"""{with_roles("jobs", "networks")} select job_id, j.name, network_name, agent_name from jobs j
    join networks n on j.network_id = n.network_id where network_name = 'NATION_7'""",
)
def jobs_with_network(spark, sf):
    networks = role(spark, sf, "networks").select("network_id", "network_name", "agent_name")
    found = analytics.jobs_with_network(role(spark, sf, "jobs"), networks, "NATION_7")
    return found.select("job_id", "name", "network_name", "agent_name")


@query(
    "schema_rules",
    """select n_nationkey as schema_id, n_name as name, s_suppkey as rule_id, s_name as target_table
    from nation left join supplier on n_nationkey = s_nationkey""",
)
def schema_rules(spark, sf):
    schemas = table(spark, sf, "nation").selectExpr("n_nationkey as schema_id", "n_name as name")
    rules = table(spark, sf, "supplier").selectExpr("s_nationkey as schema_id", "s_suppkey as rule_id", "s_name as target_table")
    return analytics.with_rules(schemas, rules)


@query(
    "network_jobs",
    f"""{with_roles("networks")} select n.network_id, network_name, c_custkey as job_id, s_name as schema_name
    from networks n left join customer c on n.network_id = c.c_nationkey
    left join supplier s on c_custkey = s_suppkey""",
)
def network_jobs(spark, sf):
    jobs = table(spark, sf, "customer")
    jobs = jobs.selectExpr("bigint(c_nationkey) as network_id", "c_custkey as job_id", "c_custkey as schema_id")
    schemas = table(spark, sf, "supplier").selectExpr("s_suppkey as schema_id", "s_name as schema_name")
    found = analytics.network_jobs(role(spark, sf, "networks"), jobs, schemas)
    return found.select("network_id", "network_name", "job_id", "schema_name")


@query(
    "schema_creator",
    """with s as (select c_custkey as schema_id,
      cast(case when c_mktsegment = 'BUILDING' then -1 else c_nationkey end as bigint) as created_by from customer)
    select schema_id, created_by, coalesce(n_name, 'System') as creator_name
    from s left join nation on created_by = n_nationkey""",
)
def schema_creator(spark, sf):
    creator = "bigint(if(c_mktsegment = 'BUILDING', -1, c_nationkey)) as created_by"
    schemas = table(spark, sf, "customer").selectExpr("c_custkey as schema_id", creator)
    users = table(spark, sf, "nation")
    return analytics.schema_creator(schemas, users.selectExpr("bigint(n_nationkey) as user_id", "n_name as username"))


@query(
    "fleet_summary",
    f"""{with_roles("heartbeats")}, nodes as (select agent_name, arg_max(status, ts) as status,
        arg_max(cpu_usage, ts) filter (cpu_usage is not null) as cpu from heartbeats group by 1)
    select count(*) as total, count(*) filter (status = 'online') as online, round(avg(coalesce(cpu, 0)), 6) as avg_cpu
    from nodes""",
)
def fleet_summary(spark, sf):
    summary = analytics.fleet_summary(analytics.node_state(role(spark, sf, "heartbeats")))
    return summary.withColumn("avg_cpu", F.round("avg_cpu", 6))


@query(
    "console_totals",
    f"""{with_roles("networks")} select (select count(*) from supplier) as schemas, count(*) as networks,
      (select count(*) from customer) as jobs, count(*) filter (status = 'online') as active_agents from networks""",
)
def console_totals(spark, sf):
    networks, jobs = role(spark, sf, "networks"), role(spark, sf, "jobs")
    return analytics.console_totals(table(spark, sf, "supplier"), networks, jobs)


@query(
    "activity_feed",
    f"""{with_roles("ran_jobs", "audit")},
      ran as (select concat('job-', cast(job_id as varchar)) as id,
        case status when 'completed' then 'Sinkronisasi selesai' when 'running' then 'Sinkronisasi berjalan'
          when 'failed' then 'Sinkronisasi gagal' else 'Job terjadwal' end as action,
        name as target, last_run as happened_at, status,
        case status when 'completed' then 'success' when 'running' then 'running' when 'failed' then 'error'
          else 'pending' end as status_type, 'job' as type
        from ran_jobs where year(last_run) > 2000),
      logged as (select concat('log-', cast(id as varchar)), trim(concat(action, ' ', coalesce(entity, ''))),
        coalesce(nullif(details, ''), nullif(username, ''), 'System Action'), created_at, 'completed',
        case action when 'LOGIN' then 'success' when 'DELETE' then 'error' when 'CREATE' then 'success'
          when 'UPDATE' then 'success' else 'info' end, 'log' from audit)
    select * from (select * from ran union all select * from logged) order by happened_at desc, id limit 6""",
)
def activity_feed(spark, sf):
    return analytics.activity_feed(role(spark, sf, "ran_jobs"), role(spark, sf, "audit"))


@query(
    "search_concat",
    f"""{with_roles("networks", "jobs")} select job_id, network_id from (
      select j.job_id, n.network_id, n.notes, concat(cast(n.network_id as varchar), ' ', network_name, ' ',
        coalesce(agent_name, ''), ' ', ip_address) as joined
      from jobs j join networks n on j.network_id = n.network_id)
    where lower(joined) like '%nation_1 10.0%' and lower(coalesce(notes, '')) like '%a%'""",
)
def search_concat(spark, sf):
    rows = role(spark, sf, "jobs").select("job_id", "network_id")
    rows = rows.join(role(spark, sf, "networks"), "network_id")
    hit = search.search_joined(["network_id", "network_name", "agent_name", "ip_address"], "Nation_1 10.0")
    return rows.filter(hit & search.search_joined(["notes"], "A")).select("job_id", "network_id")


@query(
    "search_default_group",
    """select c_custkey as id, c_name as name from customer
    where (case when c_mktsegment = 'BUILDING' then 'General' else c_mktsegment end) ilike '%GENER%'
      and (c_name ilike '%00%' or c_mktsegment ilike '%00%')""",
)
def search_default_group(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey as id", "c_name as name", "c_mktsegment as target_table", "nullif(c_mktsegment, 'BUILDING') as grp"
    )
    hit = search.search_with_default("grp", "gener") & search.any_contains(["name", "target_table"], "00")
    return rows.filter(hit).select("id", "name")


@query(
    "history_prefix",
    f"{with_roles('audit')} select id, details from audit where details like 'Agent: node1%'",
)
def history_prefix(spark, sf):
    return role(spark, sf, "audit").filter(search.history_of("details", "node1")).select("id", "details")


@query(
    "endpoint_kind",
    f"""{with_roles("networks", "jobs")} select job_id, n.network_id from jobs j join networks n
    on j.network_id = n.network_id where source_type = 'database' or coalesce(db_host, '') <> ''""",
)
def endpoint_kind(spark, sf):
    networks = role(spark, sf, "networks").filter(search.is_database_endpoint()).select("network_id")
    return role(spark, sf, "jobs").select("job_id", "network_id").join(networks, "network_id")


@query("sample_rows", "select o_orderkey, o_orderstatus as status from orders order by o_orderdate, o_orderkey limit 5")
def sample_rows(spark, sf):
    sample = analytics.sample_rows(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"])
    return sample.select("o_orderkey", F.get_json_object("sample", "$.o_orderstatus").alias("status"))


@query(
    "client_page",
    """select o_orderkey, o_orderpriority from orders where lower(o_orderpriority) like '%urgent%'
    order by o_orderkey limit 16 offset 32""",
)
def client_page(spark, sf):
    found = table(spark, sf, "orders").filter(search.contains_ci(F.col("o_orderpriority"), "URGENT"))
    return analytics.page(found.select("o_orderkey", "o_orderpriority"), 3, 16, F.asc("o_orderkey"))


@query(
    "status_outcome",
    f"""{with_roles("run_log")} select outcome, count(*) as runs from (select case when status in ('completed', 'success')
      then 'success' when status in ('failed', 'error') then 'failed' when status = 'running' then 'running' end as outcome
      from run_log) group by outcome""",
)
def status_outcome(spark, sf):
    runs = role(spark, sf, "run_log").groupBy(status.outcome(F.col("status")).alias("outcome"))
    return runs.agg(F.count(F.lit(1)).alias("runs"))


AS_OF = datetime(1999, 6, 1, 12)
TOKENS = """select o_orderkey as token_id, o_orderstatus = 'F' as revoked,
  case when o_orderpriority = '5-LOW' then null else o_orderdate end as expires_at from orders"""


@query(
    "validity_flags",
    f"""select token_id, (not revoked and (expires_at is null or expires_at >= timestamp '1999-06-01 12:00:00')) as valid
    from ({TOKENS})""",
)
def validity_flags(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    valid = status.is_valid(F.col("revoked"), F.col("expires_at"), F.lit(AS_OF).cast("timestamp_ntz"))
    return spark.sql(TOKENS).select("token_id", valid.alias("valid"))


@query(
    "days_remaining",
    """with d as (select o_orderkey, greatest(cast(floor((epoch(o_orderdate) - epoch(timestamp '1999-06-01 12:00:00'))
      / 86400) as bigint), 0) as days from orders)
    select o_orderkey, days, days <= 30 as soon from d""",
)
def days_remaining(spark, sf):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.days_remaining(F.col("o_orderdate"), as_of).alias("days"),
        text.expiring_within(F.col("o_orderdate"), as_of, 30).alias("soon"),
    )


@query(
    "duration_text",
    f"""{with_roles("run_log")}, r as (select log_id, case when status = 'pending' then 0 else duration_ms end as ms from run_log)
    select log_id, case when ms = 0 then '-' when ms < 1000 then concat(cast(ms as varchar), 'ms')
      else concat(printf('%.2f', ms / 1000.0), 's') end as shown from r""",
)
def duration_text(spark, sf):
    ms = F.when(F.col("status") == "pending", F.lit(0)).otherwise(F.col("duration_ms"))
    return role(spark, sf, "run_log").select("log_id", text.duration_text(ms).alias("shown"))


@query(
    "uptime_text",
    """with u as (select event_id, event_id * 37 as s from events)
    select event_id, case when s >= 86400 then concat(s // 86400, 'd ', s % 86400 // 3600, 'h ', s % 3600 // 60, 'm')
      when s >= 3600 then concat(s // 3600, 'h ', s % 3600 // 60, 'm') else concat(s // 60, 'm') end as uptime from u""",
)
def uptime_text(spark, sf):
    return table(spark, sf, "events").select("event_id", text.uptime_text(F.col("event_id") * 37).alias("uptime"))


@query(
    "preset_recode",
    """select o_orderkey, case o_orderpriority when '1-URGENT' then '*/5 * * * *' when '2-HIGH' then '0 */6 * * *'
      when '3-MEDIUM' then '0 0 * * 0' else '7 3 * * *' end as schedule from orders""",
)
def preset_recode(spark, sf):
    preset = F.expr(
        "case o_orderpriority when '1-URGENT' then '5min' when '2-HIGH' then '6hour' when '3-MEDIUM' then 'weekly' "
        "else '7 3 * * *' end"
    )
    return table(spark, sf, "orders").select("o_orderkey", text.preset_to_cron(preset).alias("schedule"))


@query(
    "token_hash",
    "select c_custkey, sha256(c_name) as hash, substr(c_name, 1, 8) as prefix from customer",
)
def token_hashes(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", token_hash(F.col("c_name")).alias("hash"), token_prefix(F.col("c_name")).alias("prefix")
    )


@query(
    "token_lookup",
    "select sha256(c_name) as hash, substr(c_name, 1, 8) as shown, c_custkey as owner from customer",
)
def token_lookup(spark, sf):
    customers = table(spark, sf, "customer")
    tokens = customers.select(token_hash(F.col("c_name")).alias("hash"), F.col("c_custkey").alias("owner"))
    return find_tokens(tokens, customers.selectExpr("c_name as token"))


@query(
    "numeric_metric",
    "select event_id, cast(json_extract(props, '$.k') as double) as k, cast(null as double) as missing from events",
)
def numeric_metric(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        text.numeric_metric(F.col("props"), "$.k").alias("k"),
        text.numeric_metric(F.col("props"), "$.none").alias("missing"),
    )


@query(
    "rfc3339_text",
    "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as o_orderdate from orders",
)
def rfc3339_text(spark, sf):
    return text.flat_text(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))


@query("bytes_text", "select c_custkey, c_name from customer")
def bytes_text(spark, sf):
    return text.bytes_to_text(table(spark, sf, "customer").selectExpr("c_custkey", "cast(c_name as binary) as c_name"))


@query(
    "node_state",
    f"""{with_roles("heartbeats")} select agent_name, arg_max(status, ts) as status, max(ts) as last_seen,
      arg_max(ip_address, ts) as ip_address, arg_max(cpu_usage, ts) filter (cpu_usage is not null) as cpu_usage,
      arg_max(memory_total, ts) filter (memory_total is not null) as memory_total,
      arg_max(version, ts) filter (version is not null) as version
    from heartbeats group by agent_name""",
)
def node_state(spark, sf):
    return analytics.node_state(role(spark, sf, "heartbeats"))


@query(
    "node_metrics_window",
    f"""{with_roles("heartbeats")} select agent_name, time_bucket(interval 1 hour, ts) as window_start, count(*) as reports,
      round(avg(cpu_usage), 6) as avg_cpu, max(cpu_usage) as max_cpu from heartbeats group by 1, 2""",
)
def node_metrics_window(spark, sf):
    metrics = analytics.node_metrics(role(spark, sf, "heartbeats"), "1 hour")
    return metrics.withColumn("avg_cpu", F.round("avg_cpu", 6))


@query(
    "audit_deep_page",
    f"""{with_roles("audit")}, placed as (
      select id, username, action, entity, created_at, row_number() over (order by created_at desc, id desc) - 1 as place from audit)
    select id, username, action, entity, created_at from placed where place // 50 = (select count(*) * 3 // 4 // 50 from audit)""",
)
def audit_deep_page(spark, sf):
    """A page far down all audit events, looked up in the range that holds it."""
    events = role(spark, sf, "audit").select("id", "username", "action", "entity", "created_at")
    pages = PageDirectory(spark, scratch_dir(spark, "pages")).build(events, [F.desc("created_at"), F.desc("id")], rows_a_range=2_000)
    return pages.page(pages.total() * 3 // 4 // 50 + 1, 50)
