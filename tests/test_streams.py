"""Streams must end where the batch form ends, over any split of the input and after a restart."""

import os
import time
from datetime import datetime, timedelta

from tableferry.operators.runs import fold_runs, runs_of
from tableferry.operators.tables import VersionedTable
from tableferry.session import scratch_dir
from tableferry.streaming.progress import ProgressEvents
from tableferry.streaming.throttle import stream_throttle
from tableferry.streaming.upsert import stream_run_status, stream_upsert, upsert_batches
from tableferry.streaming.watch import watch_and_mirror

T0 = datetime(2024, 1, 1)


def test_upsert_in_pieces_and_after_restart(spark, rows):
    landing, progress = scratch_dir(spark, "in"), scratch_dir(spark, "progress")
    table = VersionedTable(spark, scratch_dir(spark, "t"))
    schema = "k bigint, v string, seq int"
    for piece in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (None, "x", 1)], [(3, "d", 1)]):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        stream_upsert(stream, table, "k", ["seq"], progress).awaitTermination()
    assert rows(table.read().select("k", "v")) == [(None, "x"), (1, "c"), (2, "b"), (3, "d")]


def test_replayed_batch_changes_nothing(spark):
    table = VersionedTable(spark, scratch_dir(spark, "t"))
    write = upsert_batches(table, "q", "k", ["seq"])
    batch = spark.createDataFrame([(None, "x", 1)], "k bigint, v string, seq int")
    write(batch, 0)
    write(batch, 0)
    assert table.read().count() == 1


def test_run_status_from_late_and_split_reports(spark, rows):
    schema = "log_id int, ts timestamp_ntz, status string, record_count bigint, error string, partial boolean, sample string"
    reports = [
        [(1, T0 + timedelta(seconds=9), "completed", 1, "", False, None)],
        [(1, T0, "running", 5, "", True, "[1]"), (2, T0, "running", 1, "boom", True, None)],
        [(2, T0 + timedelta(seconds=3), "completed", 1, "", False, None)],
    ]
    landing, progress = scratch_dir(spark, "in"), scratch_dir(spark, "progress")
    log = VersionedTable(spark, scratch_dir(spark, "log"))
    seen, progressed = [], []
    listener = ProgressEvents(lambda event, query, n: seen.append(event))
    spark.streams.addListener(listener)
    try:
        for piece in reports:
            spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(landing)
            query = stream_run_status(spark.readStream.schema(schema).parquet(landing), log, progress)
            query.awaitTermination()
            progressed += query.recentProgress
    finally:
        spark.streams.removeListener(listener)
    whole = fold_runs(spark.createDataFrame([r for piece in reports for r in piece], schema))
    assert rows(runs_of(log.read())) == rows(whole)
    assert not any(p["stateOperators"] for p in progressed) and len(log.versions()) <= 5
    assert {"started", "progress"} <= set(seen)


def test_limiter_keeps_columns_and_passes_events_without_a_time(spark, rows):
    schema = "user string, ts timestamp_ntz, note string"
    landing, out = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    events = [("a", T0, "x"), ("a", None, "y"), ("a", T0 + timedelta(seconds=1), "z"), (None, T0, "n")]
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(landing)
    judged = stream_throttle(spark.readStream.schema(schema).parquet(landing), "user", "ts", 1, 60)
    writer = judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination(60)
    got = spark.read.parquet(out)
    assert sorted((r["note"], r["allowed"]) for r in got.collect()) == [("n", True), ("x", True), ("y", None), ("z", False)]


def test_versions_of_a_stream_expire(spark):
    table = VersionedTable(spark, scratch_dir(spark, "t"))
    write = upsert_batches(table, "q", "k", ["seq"])
    for i in range(8):
        write(spark.createDataFrame([(i, "x", 1)], "k bigint, v string, seq int"), i)
    assert table.read().count() == 8 and len(table.versions()) == 5


def test_a_watch_goes_on_where_it_was_stopped(spark, tmp_path):
    source, target, progress = tmp_path / "in", tmp_path / "out", str(tmp_path / "progress")
    events = []

    def passes():
        query = watch_and_mirror(spark, str(source), str(target), progress, "*.txt", on_event=lambda e, n: events.append((e, n)), availableNow=True)
        query.awaitTermination()

    def put(name, text, at):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(text)
        os.utime(source / name, (at, at))

    for i in range(5):
        put(f"sub{i}/a{i}.txt", f"text {i}", 1_700_000_000 + i)
    put("top.txt", "top", 1_700_000_000)
    put("sub1/other.csv", "x", 1_700_000_000)
    passes()
    assert events == [("initial_sync_complete", 6)] and (target / "top.txt").read_text() == "top"
    passes()
    assert len(events) == 1
    now = time.time() + 10
    put("sub2/a2.txt", "a longer text", now)
    put("new/b.txt", "b", now)
    passes()
    assert events[1:] == [("sync_complete", 2)]
    assert (target / "sub2/a2.txt").read_text() == "a longer text" and (target / "new/b.txt").exists() and not (target / "sub1/other.csv").exists()


def test_a_watch_tries_failed_copies_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a")
    (tmp_path / "out/a.txt").mkdir(parents=True)
    (tmp_path / "out/a.txt/blocks").write_text("the name is a folder")
    progress, events = str(tmp_path / "progress"), []
    for i in range(2):
        watch_and_mirror(spark, str(tmp_path / "in"), str(tmp_path / "out"), progress, on_event=lambda e, n: events.append(n), availableNow=True).awaitTermination()
        if not i:
            (tmp_path / "out/a.txt").rename(tmp_path / "moved")
    assert events == [1, 1] and (tmp_path / "out/a.txt").read_text() == "a"
    assert not (tmp_path / "progress/not-copied/again").exists()
