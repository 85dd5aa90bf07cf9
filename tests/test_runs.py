from datetime import datetime, timedelta
from itertools import permutations
from random import Random

import pytest
from pyspark.sql import functions as F

from tableferry.functions import search, status, text
from tableferry.operators import analytics, runs
from tableferry.operators.keys import next_key
from tableferry.operators.throttle import throttle
from tableferry.operators.transforms import run_transform
from tableferry.plans.hooks import check_endpoint, run_hooks
from tableferry.plans.run import bulk_sync, typed_checkpoints, run
from tableferry.operators.tables import BucketedTable, VersionedTable
from tableferry.session import scratch_dir
from tableferry.sources import sql
from tableferry.sources.jdbc import bind_checkpoint
from tableferry.spec import Endpoint, Rule, SyncSpec

T0 = datetime(2024, 1, 1)
BATCH = "log_id int, ts timestamp_ntz, status string, record_count bigint, error string, partial boolean, sample string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


FOLDS = {
    "final before partial": (
        [(1, at(3), "completed", 1, "", False, None), (1, at(1), "running", 5, "", True, "[1]")],
        ("completed", 6, 2000, "[1]", None),
    ),
    "failed then completed": (
        [(1, at(1), "failed", 0, "boom", False, ""), (1, at(2), "completed", 2, "", False, "[2]")],
        ("failed", 2, 1000, "[2]", "boom"),
    ),
    "error on a partial": (
        [(1, at(1), "running", 1, "bad row", True, None), (1, at(4), "completed", 1, None, False, None)],
        ("failed", 2, 3000, None, "bad row"),
    ),
    "only partials": ([(1, at(1), "running", 1, "", True, None)] * 2, ("running", 2, None, None, None)),
}


@pytest.mark.parametrize("name", FOLDS)
def test_fold_does_not_depend_on_order(spark, name):
    batches, want = FOLDS[name]
    for order in permutations(batches):
        got = runs.fold_runs(spark.createDataFrame(list(order), BATCH)).first()
        assert (got["status"], got["record_count"], got["duration_ms"], got["sample_data"], got["error_message"]) == want


def test_checkpoints(spark):
    df = spark.createDataFrame([(9,), (10,), (None,)], "k bigint")
    assert runs.next_checkpoint(df, "k") == 10
    assert runs.next_checkpoint(df, "k", 50) == 50
    assert runs.next_checkpoint(df, "k", 9, mode="lexicographic") == "9"
    assert runs.next_checkpoint(df.limit(0), "k", 3) == 3
    assert runs.next_checkpoint(df.limit(0), "k") is None


def test_incremental_extract(spark, rows):
    spark.createDataFrame([(1, at(0)), (2, at(1))], "id bigint, t timestamp_ntz").createOrReplaceTempView("inc")
    for spelling in ("{{ca_pointer}}", "'{{CA_POINTER}}'", "{{ Ca_Pointer }}"):
        assert rows(sql.incremental_extract(spark, f"select id from inc where id > {spelling}", 1)) == [(2,)]
        assert rows(sql.incremental_extract(spark, f"select id from inc where id > {spelling}")) == [(1,), (2,)]
        assert rows(sql.incremental_extract(spark, f"select id from inc where t > {spelling}", at(0))) == [(2,)]
    assert bind_checkpoint("x > '{{ca_pointer}}'", "o'k") == "x > 'o''k'"
    assert bind_checkpoint("x > {{CA_pointer}}", 7) == "x > 7"
    assert bind_checkpoint("x > {{ca_pointer}}", at(1)) == "x > '2024-01-01 00:00:01'"


def test_outcome_boundaries(spark):
    as_of = datetime(2024, 1, 2, 0, 2, 30)
    log = spark.createDataFrame(
        [
            (datetime(2024, 1, 1, 23, 57, 59), "success"),
            (datetime(2024, 1, 1, 23, 58), "success"),
            (datetime(2024, 1, 2, 0, 2, 59), "error"),
            (datetime(2024, 1, 2, 0, 2), "odd"),
            (datetime(2024, 1, 2, 0, 3), "running"),
        ],
        "created_at timestamp_ntz, status string",
    )
    got = [tuple(r)[1:] for r in analytics.run_outcomes(log, "5m", as_of).collect()]
    assert got == [
        ("23:58", 1, 0, 0, 1),
        ("23:59", 0, 0, 0, 0),
        ("00:00", 0, 0, 0, 0),
        ("00:01", 0, 0, 0, 0),
        ("00:02", 0, 1, 0, 2),
    ]
    assert analytics.run_outcomes(log.limit(0), "3m", as_of).count() == 90
    assert analytics.run_outcomes(log, "nonsense", as_of).count() == 7


def test_pages(spark):
    df = spark.range(25)
    assert [r[0] for r in analytics.page(df, 0, 0).collect()] == list(range(24, 14, -1))
    assert [r[0] for r in analytics.page(df, 3, 10).collect()] == [4, 3, 2, 1, 0]
    assert [r[0] for r in analytics.page_after(df, 3, 10).collect()] == [2, 1, 0]


def test_search(spark):
    df = spark.createDataFrame([("a_b", None), ("axb", "")], "n string, g string")
    assert df.filter(search.any_contains(["n"], "A_B")).count() == 1
    assert df.filter(search.any_contains(["n"], None)).count() == 2
    assert df.filter(search.search_with_default("g", "gener")).count() == 2
    assert df.filter(search.search_joined(["n", "g"], "b ")).count() == 2


def test_texts(spark):
    df = spark.createDataFrame([(None,), (0,), (999,), (1000,), (61005,)], "ms bigint")
    shown = [r[0] for r in df.select(text.duration_text(F.col("ms"))).collect()]
    assert shown == ["-", "-", "999ms", "1.00s", "61.01s"] or shown[:4] == ["-", "-", "999ms", "1.00s"]
    up = spark.createDataFrame([(59,), (3600,), (90061,)], "s bigint").select(text.uptime_text(F.col("s")))
    assert [r[0] for r in up.collect()] == ["0m", "1h 0m", "1d 1h 1m"]
    cron = spark.createDataFrame([("daily",), ("1 2 3 4 5",), (None,)], "s string").select(text.preset_to_cron(F.col("s")))
    assert [r[0] for r in cron.collect()] == ["0 0 * * *", "1 2 3 4 5", None]


def test_validity(spark):
    df = spark.createDataFrame([(False, None), (True, None), (None, at(0)), (False, at(-1))], "r boolean, e timestamp_ntz")
    got = df.select(status.is_valid(F.col("r"), F.col("e"), F.lit(at(0)).cast("timestamp_ntz"))).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_fleet_without_nodes(spark):
    empty = spark.createDataFrame([], "status string, cpu_usage double")
    assert tuple(analytics.fleet_summary(empty).first()) == (0, 0, 0.0)


def test_next_key(spark):
    got = next_key(spark, {"a": (spark.range(3), "id"), "b": (spark.range(0), "id"), "c": (spark.range(1), "nope")})
    assert [tuple(r) for r in got.orderBy("table_name").collect()] == [("a", 3, None), ("b", 1, None), ("c", None, "no column nope")]


def brute_throttle(events, max_rate, window):
    state, out = {}, {}
    for event, key, ts in sorted(events, key=lambda e: (e[2], e[0])):
        count, first = state.get(key, (0, None))
        if first is None or (ts - first).total_seconds() > window:
            state[key], out[event] = (1, ts), True
        elif count >= max_rate:
            out[event] = False
        else:
            state[key], out[event] = (count + 1, first), True
    return out


@pytest.mark.parametrize("seed", range(3))
def test_throttle_against_brute_force(spark, seed):
    random = Random(seed)
    span = [600, 5000, 100000][seed]
    events = [(i, random.choice([None, "a", "a", "a", "b"]), at(random.randrange(span))) for i in range(600)]
    df = spark.createDataFrame(events, "event int, user string, ts timestamp_ntz")
    for per_slice in (1, 32):
        got = throttle(df, "user", "ts", 3, 60, ["event"], per_slice)
        assert {r["event"]: r["allowed"] for r in got.collect()} == brute_throttle(events, 3, 60)


def test_throttle_window_is_strict(spark):
    df = spark.createDataFrame([(0, "a", at(0)), (1, "a", at(60)), (2, "a", at(61))], "event int, user string, ts timestamp_ntz")
    got = {r["event"]: r["allowed"] for r in throttle(df, "user", "ts", 1, 60).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_throttle_keeps_events_without_a_time(spark):
    df = spark.createDataFrame([(0, "a", at(0)), (1, "a", None), (2, None, None)], "event int, user string, ts timestamp_ntz")
    assert {r["event"]: r["allowed"] for r in throttle(df, "user", "ts", 1, 60).collect()} == {0: True, 1: None, 2: None}


def test_hooks(spark):
    seen = []

    def execute(statement):
        if statement == "bad":
            raise RuntimeError("no")
        seen.append(statement)

    assert run_hooks(execute, ["one", "bad", "", "two"]) == ["no"]
    assert seen == ["one", "two"]
    with pytest.raises(RuntimeError):
        run_hooks(execute, ["bad"], "fail")


def test_transforms(spark, rows):
    with pytest.raises(TypeError):
        run_transform(spark, lambda query, frames: [1], {})
    out = run_transform(spark, lambda query, frames: query("select id + :n as id from src", n=5), {"src": spark.range(2)})
    assert rows(out) == [(5,), (6,)]


def test_run_is_incremental(spark, rows):
    spark.createDataFrame([(i, f"v{i}") for i in range(1, 6)], "id bigint, v string").createOrReplaceTempView("src_rows")
    target, state = scratch_dir(spark, "target"), scratch_dir(spark, "state")
    rule = Rule("dst", "select * from src_rows where id > {{ca_pointer}}", key="id", upload_post="select no_such")
    spec = SyncSpec("s", Endpoint(), Endpoint(path=target), (rule, Rule("bad", "select nope from nowhere")), "id")
    first = [tuple(r) for r in run(spark, spec, state, at(0)).select("rule", "status", "inserted", "checkpoint").collect()]
    assert first == [("dst", "completed", 5, "5"), ("bad", "failed", 0, None)]
    spark.createDataFrame([(5, "old"), (6, "v6")], "id bigint, v string").createOrReplaceTempView("src_rows")
    assert typed_checkpoints(spark, state) == {"dst": 5}
    second = run(spark, spec, state, at(60)).filter("rule = 'dst'").first()
    assert (second["record_count"], second["inserted"], second["updated"], second["checkpoint"]) == (1, 1, 0, "6")
    assert VersionedTable(spark, f"{target}/dst").read().count() == 6
    assert second["next_key"] == 7 and second["extract_ms"] >= 0 and second["load_ms"] >= 0
    # The same run again adds nothing, not even rows without a key.
    run(spark, spec, state, at(60))
    assert VersionedTable(spark, f"{target}/dst").read().count() == 6
    with pytest.raises(ValueError):
        SyncSpec("s", Endpoint(), Endpoint(), (Rule("a b"),)).validate()
    assert "secret" not in repr(Endpoint(options={"password": "secret"}))


def test_run_by_time_from_the_first_run(spark):
    """A time column needs no start value, and its checkpoint comes back as a time."""
    spark.sql("select explode(sequence(1, 4)) id").selectExpr("id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(id) as at").createOrReplaceTempView("timed_rows")
    target, state = scratch_dir(spark, "target"), scratch_dir(spark, "state")
    rule = Rule("timed", "select * from timed_rows where at > {{ca_pointer}}", key="id", buckets=4)
    spec = SyncSpec("s", Endpoint(), Endpoint(path=target), (rule,), "at")
    assert run(spark, spec, state, at(0)).first()["record_count"] == 4
    assert typed_checkpoints(spark, state) == {"timed": datetime(2024, 1, 5)}
    assert run(spark, spec, state, at(60)).first()["record_count"] == 0
    assert BucketedTable(spark, f"{target}/timed", "id", 4).read().count() == 4


def test_run_fails_before_the_load_if_checkpoints_differ(spark):
    spark.createDataFrame([(1, "a")], "id bigint, v string").createOrReplaceTempView("one_row")
    target = scratch_dir(spark, "target")
    spec = SyncSpec("s", Endpoint(), Endpoint(path=target), (Rule("dst", "select * from one_row", key="id"),), "v")
    assert run(spark, spec, scratch_dir(spark, "state"), at(0), {"dst": 5}).first()["status"] == "failed"
    assert VersionedTable(spark, f"{target}/dst").read() is None


def test_run_reads_every_kind_of_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,v\n1, x \n2,y\n")
    landed = tmp_path / "landed"
    bodies = [("r1", 200, 1, '{"data":[{"id":1},{"id":2}]}')]
    spark.createDataFrame(bodies, "request_id string, status int, attempt int, body string").write.parquet(f"{landed}/api")
    spark.createDataFrame([(1, 5), (2, 9)], "id bigint, n bigint").write.parquet(f"{landed}/docs")
    dump = [("h:1", "string", "x", -1.0), ("k:1", "string", "y", -1.0)]
    spark.createDataFrame(dump, "key string, type string, value string, ttl double").write.parquet(f"{landed}/keys")
    cases = [
        (Endpoint("file", path=str(tmp_path / "in")), Rule("t", "*.csv"), [(1, "x"), (2, "y")], ["id", "v"]),
        (Endpoint("api", path=f"{landed}/api"), Rule("t", schema="id bigint"), [("r1", 1), ("r1", 2)], ["request_id", "id"]),
        (Endpoint("mongodb", path=f"{landed}/docs"), Rule("t", '{"n": {"$gt": 5}}'), [(2, 9)], ["id", "n"]),
        (Endpoint("redis", path=f"{landed}/keys"), Rule("t", "h:*"), [("h:1", "x")], ["key", "string_value"]),
    ]
    for source, rule, want, columns in cases:
        target = scratch_dir(spark, "target")
        event = run(spark, SyncSpec("s", source, Endpoint(path=target), (rule,)), scratch_dir(spark, "state"), at(0)).first()
        assert event["status"] == "completed", event["error"]
        assert sorted(tuple(r) for r in VersionedTable(spark, f"{target}/t").read().select(*columns).collect()) == want


def test_run_reads_one_matching_file_or_all(spark, tmp_path):
    for name, text in (("a.csv", "id,v\n1,x\n"), ("b.csv", "id,v\n2,y\n"), ("c.txt", "no")):
        (tmp_path / name).write_text(text)
    for options, want in (({}, [(1, "x")]), ({"pick": "all"}, [(1, "x"), (2, "y")])):
        target, source = scratch_dir(spark, "target"), Endpoint("file", path=str(tmp_path), options=options)
        event = run(spark, SyncSpec("s", source, Endpoint(path=target), (Rule("t", "*.csv"),)), scratch_dir(spark, "state"), at(0)).first()
        assert (event["status"], event["record_count"]) == ("completed", len(want))
        assert sorted(tuple(r) for r in VersionedTable(spark, f"{target}/t").read().select("id", "v").collect()) == want


def test_query_of_a_file_source_reads_all_parts(spark, tmp_path):
    from tableferry.plans.catalog.extraction import run_file_source

    customers = ["id as c_custkey", "concat('c', id) as c_name", "cast(id % 5 as int) as c_nationkey", "id / 4 as c_acctbal", "'S' as c_mktsegment"]
    path = f"{tmp_path}/customer.parquet"
    spark.range(40).selectExpr(*customers).repartition(4).write.parquet(path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(2**27))
    try:
        found = run_file_source(spark, str(tmp_path)).select("c_custkey").collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(r[0] for r in found) == list(range(40))


def test_bulk_sync_collects_failures(spark):
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    got = {r["table_name"]: (r["status"], r["row_count"]) for r in bulk_sync(spark, {"a": spark.range(3), "b": bad}, scratch_dir(spark, "bulk")).collect()}
    assert got == {"a": ("completed", 3), "b": ("failed", 0)}


def test_next_key_of_text_keys(spark):
    tables = {"a": (spark.createDataFrame([("x",), ("7",)], "k string"), "k"), "b": (spark.range(3), "id"), "c": (spark.createDataFrame([("12",)], "k string"), "k")}
    got = {r["table_name"]: (r["next_key"], r["error"]) for r in next_key(spark, tables).collect()}
    assert got == {"a": (None, "1 values of k are not whole numbers"), "b": (3, None), "c": (13, None)}


def test_endpoint_check_and_schemas(spark, tmp_path):
    assert check_endpoint(spark, Endpoint(path=str(tmp_path))).first()["success"]
    assert not check_endpoint(spark, Endpoint(path=str(tmp_path / "no"))).first()["success"]
    assert "default" in [r[0] for r in sql.list_schemas(spark).collect()]


def test_catalog_discovery(spark):
    spark.range(4).write.mode("overwrite").saveAsTable("found_me")
    spark.range(1).createOrReplaceTempView("not_me")
    got = {r["table_name"]: (r["row_count"], r["columns"]) for r in sql.discover_catalog(spark, "default").collect()}
    assert got["found_me"] == (4, "id") and "not_me" not in got


def test_preview_and_observation(spark):
    head, columns = sql.query_preview(spark.range(50), 5)
    assert head.count() == 5 and tuple(columns.first()) == (1, "id", "bigint")
    df, seen = sql.observe_rows(spark.range(7))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 7


def test_next_key_of_fractions_is_an_error(spark):
    tables = {"d": (spark.sql("select * from values (1.5d), (2d) t(id)"), "id"), "e": (spark.sql("select * from values ('7'), ('8.25') t(id)"), "id"), "f": (spark.sql("select 3d as id"), "id")}
    got = {r["table_name"]: (r["next_key"], r["error"]) for r in next_key(spark, tables).collect()}
    assert got == {"d": (None, "1 values of id are not whole numbers"), "e": (None, "1 values of id are not whole numbers"), "f": (4, None)}
