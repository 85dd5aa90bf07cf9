"""The run log: outcomes per time bucket, folds, repairs, latest runs, limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tableferry.operators import analytics, runs
from tableferry.operators.export import export_records
from tableferry.operators.throttle import throttle
from tableferry.plans.catalog.registry import query, role, table, with_roles
from tableferry.session import scratch_dir
from tableferry.sources.files import read_json

AS_OF = datetime(2024, 1, 30, 23, 58, 30)
AS_OF_SQL = "timestamp '2024-01-30 23:58:30'"
LABELS = {"minute": "%H:%M", "hour": "%Y-%m-%d %H:00", "day": "%Y-%m-%d"}


def _outcome_sql(span: analytics.Span) -> str:
    return f"""{with_roles("run_log")}, spine as (
      select unnest(generate_series(date_trunc('{span.unit}', {AS_OF_SQL}) - interval '{span.steps - 1}' {span.unit},
        date_trunc('{span.unit}', {AS_OF_SQL}), interval 1 {span.unit}))::timestamp as bucket)
    select bucket, strftime(bucket, '{LABELS[span.unit]}') as date,
      count(*) filter (status in ('completed', 'success')) as success,
      count(*) filter (status in ('failed', 'error')) as failed,
      count(*) filter (status = 'running') as running, count(status) as total
    from spine left join run_log on date_trunc('{span.unit}', created_at) = bucket group by bucket"""


def _outcomes(range: str):
    return lambda spark, sf: analytics.run_outcomes(role(spark, sf, "run_log"), range, AS_OF)


for _range, _span in analytics.RANGES.items():
    query(f"run_outcomes_{_range}", _outcome_sql(_span))(_outcomes(_range))


FOLDED = f"""{with_roles("batches")}, folded as (
  select log_id, cast(sum(record_count) as bigint) as record_count, bool_or(error <> '' or status = 'failed') as bad,
    arg_max(status, ts) filter (not partial) as final_status, min(ts) as started_at,
    max(ts) filter (not partial) as completed_at, arg_max(sample, ts) filter (sample <> '') as sample_data,
    arg_max(error, ts) filter (error <> '') as error_message
  from batches group by log_id)
select log_id, case when bad then 'failed' else coalesce(final_status, 'running') end as status, record_count,
  started_at, completed_at,
  cast(floor((epoch_us(completed_at) - epoch_us(started_at)) / 1000) as bigint) as duration_ms,
  sample_data, error_message
from folded"""


@query("run_log_fold", FOLDED)
def run_log_fold(spark, sf):
    return runs.fold_runs(role(spark, sf, "batches"))


@query(
    "run_metrics",
    f"""select log_id, record_count, started_at, completed_at, duration_ms,
      case when completed_at is not null then record_count * 1000 / greatest(coalesce(duration_ms, 0), 1)::double end
        as rows_per_second
    from ({FOLDED})""",
)
def run_metrics(spark, sf):
    return runs.run_metrics(runs.fold_runs(role(spark, sf, "batches")))


@query(
    "latest_runs_per_job",
    f"""{with_roles("run_log")} select log_id, job_id, created_at, status from run_log
    qualify row_number() over (partition by job_id order by created_at desc, log_id desc) <= 10""",
)
def latest_runs_per_job(spark, sf):
    return runs.latest_runs(role(spark, sf, "run_log"), 10).select("log_id", "job_id", "created_at", "status")


@query(
    "recent_runs",
    f"""{with_roles("run_log", "jobs")} select r.log_id, r.job_id, r.created_at, r.status, j.name
    from (select * from run_log order by created_at desc, log_id desc limit 10) r left join jobs j on r.job_id = j.job_id""",
)
def recent_runs(spark, sf):
    jobs = role(spark, sf, "jobs").select("job_id", "name")
    return runs.recent_runs(role(spark, sf, "run_log"), jobs).select("log_id", "job_id", "created_at", "status", "name")


@query(
    "latest_running_run",
    f"""{with_roles("run_log")} select job_id, arg_max(log_id, created_at) as log_id, max(created_at) as created_at
    from run_log where status = 'running' group by job_id""",
)
def latest_running_run(spark, sf):
    return runs.latest_running(role(spark, sf, "run_log")).select("job_id", "log_id", "created_at")


@query(
    "stale_run_repair",
    f"""{with_roles("run_log", "jobs")}, f as (select job_id from jobs where status = 'failed')
    select log_id, r.job_id, created_at, duration_ms,
      case when stale then 'failed' else status end as status,
      case when stale then 'Job was marked as failed (possible agent disconnect)' else error_message end as error_message,
      case when stale then {AS_OF_SQL} else completed_at end as completed_at
    from (select r.*, (f.job_id is not null and r.status = 'running') as stale
          from run_log r left join f on r.job_id = f.job_id) r""",
)
def stale_run_repair(spark, sf):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return runs.repair_stale(role(spark, sf, "run_log"), role(spark, sf, "jobs"), as_of)


@query(
    "abort_running_runs",
    f"""{with_roles("run_log", "jobs")}, a as (select arg_max(log_id, created_at) as log_id from run_log
      where status = 'running' and job_id in (select job_id from jobs where status = 'running') group by job_id)
    select r.log_id, job_id, case when a.log_id is null then status else 'failed' end as status,
      case when a.log_id is null then error_message else 'Aborted by user' end as error_message,
      case when a.log_id is null then completed_at else {AS_OF_SQL} end as completed_at
    from run_log r left join a on r.log_id = a.log_id""",
)
def abort_running_runs(spark, sf):
    running = role(spark, sf, "jobs").filter("status = 'running'")
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    done = runs.abort_run(role(spark, sf, "run_log"), running, as_of)
    return done.select("log_id", "job_id", "status", "error_message", "completed_at")


@query(
    "aborted_filter",
    f"""{with_roles("run_log", "jobs")} select log_id, job_id from run_log
    where job_id not in (select job_id from jobs where status = 'failed')""",
)
def aborted_filter(spark, sf):
    aborted = role(spark, sf, "jobs").filter("status = 'failed'")
    return runs.drop_aborted(role(spark, sf, "run_log"), aborted).select("log_id", "job_id")


@query(
    "rule_lookup",
    f"""{with_roles("jobs")}, rules as (select dest_table as target_table, min(job_id) as rule_id,
        arg_min(name, job_id) as rule_name from jobs group by dest_table),
      batches as (select job_id, case when status = 'failed' then 'OTHER' else dest_table end as target_table from jobs)
    select job_id, b.target_table, rule_id, rule_name from batches b
    left join rules on b.target_table = rules.target_table""",
)
def rule_lookup(spark, sf):
    jobs = role(spark, sf, "jobs")
    rules = jobs.selectExpr("job_id as rule_id", "dest_table as target_table", "name as rule_name")
    batches = jobs.selectExpr("job_id", "if(status = 'failed', 'OTHER', dest_table) as target_table")
    return analytics.batch_rules(batches, rules)


@query(
    "throttle_events",
    """with recursive starts as (
      select user_id, min(ts) as opened from events group by user_id
      union all
      select s.user_id, (select min(e.ts) from events e where e.user_id = s.user_id
        and e.ts > s.opened + interval 12 hour) as opened
      from starts s where s.opened is not null)
    select event_id, user_id, ts, n <= 3 as allowed from (
      select e.event_id, e.user_id, e.ts,
        row_number() over (partition by e.user_id, s.opened order by e.ts, e.event_id) as n
      from events e asof join (select * from starts where opened is not null) s
        on e.user_id = s.user_id and e.ts >= s.opened)""",
)
def throttle_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return throttle(events, "user_id", "ts", 3, 12 * 3600, ["event_id"], windows_per_slice=4)


def _log_lines(spark, sf):
    """Events as a structured JSON log, written and read back as text lines."""
    lines = table(spark, sf, "events").select(
        F.col("ts").alias("time"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.concat(F.lit("agent "), "event_type", F.lit(" "), "props").alias("message"),
    )
    path = scratch_dir(spark, "log")
    export_records(lines, path, "jsonl")
    return read_json(spark, path, multiline=False, schema="time timestamp_ntz, level string, message string")


@query(
    "log_errors_window",
    "select count(*) as errors from events where event_type = 'error' "
    "and ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-11 00:00:00'",
)
def log_errors_window(spark, sf):
    return analytics.log_errors(_log_lines(spark, sf), datetime(2024, 1, 10), datetime(2024, 1, 11))


@query("log_distinct", "select distinct concat('agent error ', props) as message from events where event_type = 'error'")
def log_distinct(spark, sf):
    return analytics.log_distinct_errors(_log_lines(spark, sf))


@query(
    "log_contains",
    "select ts as time, 'info' as level, concat('agent signup ', props) as message from events where event_type = 'signup'",
)
def log_contains(spark, sf):
    return analytics.log_containing(_log_lines(spark, sf), "agent signup")
