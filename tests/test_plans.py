"""What the plans must look like for large tables."""

import re

import pytest
from plans import plan_of
from tableferry.functions.infer import infer_schema
from tableferry.functions.protect import derive_key
from tableferry.operators.dedupe import one_per_key
from tableferry.operators.merge import staged_upsert, upsert
from tableferry.operators.runs import latest_runs
from tableferry.plans.catalog import QUERIES
from tableferry.plans.catalog.registry import role, table
from tableferry.sources.documents import find

SF = "/root/testdata/sf0.001"


def test_checkpoint_predicate_reaches_the_scan(spark):
    plan = plan_of(QUERIES["incremental_extract"](spark, SF))
    assert "GreaterThan(o_orderdate,1998-06-30" in plan and "o_custkey" not in plan


def test_document_filter_reaches_the_scan(spark):
    plan = plan_of(find(table(spark, SF, "events"), {"event_type": "click", "value": {"$gt": 3}}).select("event_id"))
    assert "GreaterThan(value,3.0)" in plan and re.search(r"PushedFilters: \[.*EqualNullSafe\(event_type,click\)", plan)


def test_outcomes_read_two_columns_in_their_range(spark):
    plan = plan_of(QUERIES["run_outcomes_24h"](spark, SF))
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string>", plan)


def test_dedupe_aggregates_before_its_only_shuffle(spark):
    plan = plan_of(one_per_key(role(spark, SF, "orders_feed"), "o_orderkey", ["shipped_at"]))
    assert plan.count("Exchange") == 1 and "partial_max" in plan and "Window" not in plan


def test_upsert_shuffles_each_side_once(spark):
    t, s = role(spark, SF, "orders_target"), role(spark, SF, "orders_feed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan_of(upsert(t, s, "o_orderkey", ["shipped_at"], target_unique=True)).count("Exchange hash") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_staged_merge_does_not_shuffle_the_target(spark):
    t, s = role(spark, SF, "orders_target"), role(spark, SF, "orders_feed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = plan_of(staged_upsert(t, s, "o_orderkey", ["shipped_at"]))
        large = plan_of(staged_upsert(t, s, "o_orderkey", ["shipped_at"], broadcast_bytes=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin LeftOuter" not in small and "BroadcastHashJoin" in small
    assert "BroadcastHashJoin" not in large


def test_latest_runs_limits_groups_before_the_shuffle(spark):
    plan = plan_of(latest_runs(role(spark, SF, "run_log"), 10))
    assert plan.count("WindowGroupLimit") == 2 and plan.index("WindowGroupLimit") < plan.rindex("Exchange")


def test_no_query_gathers_a_table_in_one_window(spark):
    for name in ("latest_runs_per_job", "throttle_events", "txt_lines", "latest_per_key"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert not re.search(r"Window \[.*\], \[(?!.*\]).*SinglePartition", plan)
        assert "Exchange SinglePartition" not in plan, name


def test_messages_are_unpacked_once(spark):
    assert plan_of(QUERIES["message_log"](spark, SF)).count("ArrowEvalPython") == 1


def test_keys_stand_in_no_plan(spark):
    key = derive_key("fixture secret", b"fixture salt")
    df = QUERIES["encrypt_roundtrip"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert key.hex().upper() not in plan.upper().replace(" ", "") and "aes_" in plan.lower()


def test_comparison_scans_each_side_once_and_sorts_nothing(spark):
    plan = plan_of(QUERIES["compare_tables"](spark, SF))
    assert plan.count("FileScan") == 2 and "Sort" not in plan and "Join" not in plan and plan.count("Exchange hash") == 1


def test_limiter_limits_windows_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["throttle_events"](spark, SF))


def test_inference_makes_no_rows(spark):
    seen = []
    original = type(spark.range(1)).first
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.range(1)), "first", lambda self: seen.append(plan_of(self)) or original(self))
        infer_schema(spark.createDataFrame([("1", "x")], "a string, b string"))
    assert len(seen) == 1 and "Generate" not in seen[0]


def test_counts_read_no_columns(spark):
    plan = plan_of(QUERIES["table_discovery"](spark, SF))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)) == {"struct<>"}
