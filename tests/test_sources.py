import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tableferry.functions.protect import decrypt, derive_key, encrypt, gzip_base64, unpack
from tableferry.operators.export import export_records, export_result
from tableferry.operators.jdbc_sink import column_types, drop_statement, key_statement, merge_statement, next_key_statement
from tableferry.operators.mirror import content_type, mirror, mirror_errors, mirror_stats
from tableferry.session import scratch_dir
from tableferry.sources import documents, keyspace, messages, responses, sql
from tableferry.sources.jdbc import table_query
from tableferry.streaming.watch import Watch


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, (5,), "x"), (2, (7,), None), (3, None, None)], "_id int, a struct<b:int>, tag string")


@pytest.mark.parametrize(
    "wanted,ids",
    [
        ({"tag": "x"}, [1]),
        ({"tag": None}, [2, 3]),
        ({"tag": {"$ne": "x"}}, [2, 3]),
        ({"a.b": {"$gt": 5}}, [2]),
        ({"a": {"b": 5}}, [1]),
        ({"a.b": {"$in": [7, None]}}, [2, 3]),
        ({"a.b": {"$nin": [7]}}, [1, 3]),
        ({"tag": {"$exists": True}}, [1]),
        ({"gone": {"$exists": False}}, [1, 2, 3]),
        ({"$or": [{"_id": 1}, {"_id": {"$gte": 3}}], "gone": None}, [1, 3]),
        ({"$and": [{"_id": {"$lt": 3}}, {"_id": {"$lte": 1}}]}, [1]),
        ('{"_id": 2}', [2]),
        ({}, [1, 2, 3]),
    ],
)
def test_find(docs, wanted, ids):
    assert sorted(r["_id"] for r in documents.find(docs, wanted).collect()) == ids


def test_bad_filters(docs):
    for bad in ("{broken", "[1]"):
        with pytest.raises(ValueError):
            documents.find(docs, bad)
        assert documents.find(docs, bad, on_invalid="all").count() == 3
    with pytest.raises(ValueError):
        documents.find(docs, {"tag": {"$regex": "x"}})
    with pytest.raises(ValueError):
        documents.aggregate(docs, [{"$lookup": {}}])


def test_aggregate_stages(docs, rows):
    out = documents.aggregate(docs, [{"$sort": {"_id": -1}}, {"$skip": 1}, {"$limit": 1}, {"$project": {"_id": 1}}])
    assert rows(out) == [(2,)]
    assert rows(documents.aggregate(docs, [{"$count": "n"}])) == [(3,)]
    total = [{"$group": {"_id": None, "s": {"$sum": "$a.b"}, "n": {"$count": {}}}}]
    assert rows(documents.aggregate(docs, total)) == [(12, 3)]
    arrays = docs.select("_id", F.array(F.lit(1), F.lit(2)).alias("v"))
    assert documents.aggregate(arrays, [{"$unwind": "$v"}, {"$project": {"_id": 0}}]).columns == ["v"]


def test_key_space(spark, rows):
    dump = spark.createDataFrame(
        [
            ("u:1", "hash", '{"a":"1"}', -1.0),
            ("u:2", "hash", '{"b":"2"}', 5.0),
            ("s/x", "string", "{not json", 1.0),
            ("l", "list", '["b","a"]', -1.0),
            ("z", "zset", '[{"member":"m","score":2.0},{"member":"k","score":1.0}]', -1.0),
        ],
        "key string, type string, value string, ttl double",
    )
    assert rows(keyspace.hash_flatten(dump)) == [("u:1", "1", None), ("u:2", None, "2")]
    assert keyspace.scan_keys(dump, "s*").first()["string_value"] == "{not json"
    got = {r["key"]: r for r in keyspace.scan_keys(dump).collect()}
    assert got["l"]["list_value"] == ["b", "a"] and [m["member"] for m in got["z"]["zset_value"]] == ["k", "m"]
    assert keyspace.scan_keys(dump, "none*").count() == 0


def test_unreadable_responses_are_kept(spark, rows):
    bodies = [("r1", 200, 1, '{"data":[{"a":1}]}'), ("r2", 200, 1, "<html>"), ("r3", 200, 1, '{"data":5,"a":3}'), ("r4", 200, 1, "[]"), ("r5", 500, 1, "no")]
    df = spark.createDataFrame(bodies, "request_id string, status int, attempt int, body string")
    assert rows(responses.response_records(df, "a int")) == [("r1", 1), ("r3", 3)]
    assert rows(responses.response_rejects(df, "a int").select("request_id", "body")) == [("r2", "<html>")]


def test_discovery_tells_schemas_apart(spark, rows):
    tables = spark.createDataFrame([("s1", "t"), ("s2", "t")], "schema string, table_name string")
    estimates = spark.createDataFrame([("s1", "t", 7)], "schema string, table_name string, row_count bigint")
    columns = spark.createDataFrame([("s1", "t", 1, "a"), ("s2", "t", 1, "x"), ("s2", "t", 2, "y")], "schema string, table_name string, position int, column_name string")
    assert rows(sql.join_discovery(tables, estimates, columns)) == [("s1", "t", 7, "a"), ("s2", "t", 0, "x, y")]


def test_responses(spark, rows):
    df = spark.createDataFrame(
        [
            (1, "u", 429, 1, None),
            (1, "u", 200, 2, '{"data":[{"a":1},{"a":2}]}'),
            (2, "u", 500, 4, "x"),
            (3, "u", 404, 1, "x"),
            (4, "u", 204, 1, '{"a":7}'),
            (5, "u", 200, 1, '[{"a":8}]'),
        ],
        "request_id int, url string, status int, attempt int, body string",
    )
    outcome = {r["request_id"]: r["outcome"] for r in responses.final_responses(df).collect()}
    assert outcome == {1: "ok", 2: "retryable", 3: "final", 4: "ok", 5: "ok"}
    assert rows(responses.response_records(df, "a int")) == [(1, 1), (1, 2), (4, 7), (5, 8)]


def test_protection(spark, rows):
    key = derive_key("k", b"salt")
    df = spark.createDataFrame([("é" * 200,), ("",), (None,)], "v string")
    sealed = df.select("v", encrypt(F.col("v"), key).alias("e"))
    assert all("\n" not in r["e"] and r["e"].startswith("ENC:") for r in sealed.filter("v is not null").collect())
    assert sealed.select(decrypt(F.col("e"), key).eqNullSafe(F.col("v"))).distinct().collect() == [(True,)]
    other = derive_key("other", b"salt")
    assert sealed.filter("v is not null").select(decrypt(F.col("e"), other)).distinct().collect() == [(None,)]
    odd = spark.createDataFrame([("plain",), ("GZ:!!",), ("GZ:YWJj",)], "v string")
    assert rows(odd.select(unpack(F.col("v")))) == [(None,), (None,), ("plain",)]
    packed = df.select("v", F.concat(F.lit("GZ:"), gzip_base64(F.col("v"))).alias("p"))
    assert packed.select(unpack(F.col("p")).eqNullSafe(F.col("v"))).distinct().collect() == [(True,)]


def test_payloads_are_handed_over_in_small_batches(spark):
    df = spark.range(3).select(F.concat(F.lit("GZ:"), gzip_base64(F.col("id").cast("string"))).alias("p"))
    plan = df.select(unpack(F.col("p")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 2 and "ArrowEvalPython" not in plan


def test_payloads_that_are_no_ascii_are_broken(spark):
    assert spark.createDataFrame([("GZ:é",)], "v string").select(unpack(F.col("v"))).first()[0] is None


def test_messages(spark):
    lines = [
        '{"type":"HEARTBEAT","agent_name":"n","status":"online","timestamp":"2024-01-01T00:00:00Z","data":{"cpu_usage":1.5,"version":"v1"}}',
        '{"type":"DATA_RESPONSE","agent_name":"n","timestamp":"2024-01-01T00:00:01Z","data":{"job_id":1,"log_id":7,"record_count":2,"partial":true,"records":[{"a":1}]}}',
        "{broken",
        "[1]",
        "ENC:AAAA",
        "  ",
    ]
    parsed = messages.parse_messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert messages.bad_messages(parsed).count() == 3
    beat = messages.heartbeats(parsed).first()
    assert (beat["agent_name"], beat["cpu_usage"], beat["memory_total"], beat["version"]) == ("n", 1.5, None, "v1")
    batch = messages.run_batches(parsed).first()
    assert (batch["log_id"], batch["status"], batch["record_count"], batch["partial"]) == (7, "completed", 2, True)
    assert json.loads(batch["sample"]) == [{"a": 1}]


def test_exports(spark, rows):
    df = spark.sql("select 1 id, 'a\"b,c' v, timestamp_ntz'2024-01-01 00:00:00.123456' t, cast(null as string) n")
    for format in ("csv", "json", "jsonl", "parquet"):
        path = scratch_dir(spark, "x")
        export_records(df, path, format, single_file=True)
        if format == "jsonl":
            assert json.loads(spark.read.text(path).first()[0])["t"] == "2024-01-01T00:00:00.123456"
    with pytest.raises(ValueError):
        export_records(df.limit(0), scratch_dir(spark, "x"), "csv")
    with pytest.raises(ValueError):
        export_records(df, scratch_dir(spark, "x"), "xml")
    path = scratch_dir(spark, "grid")
    export_result(df.select("id", "v", "n"), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ["id,v,n", '1,"a\\"b,c",null']
    assert content_type("CSV") == "text/csv" and content_type("?") == "application/octet-stream"


def test_mirror(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    (source / "d").mkdir(parents=True)
    (source / "a.txt").write_text("aa")
    (source / "d" / "ü b.txt").write_text("b")
    (source / "c.bin").write_text("c")

    def stats(**options):
        return tuple(mirror_stats(mirror(spark, str(source), str(target), **options)).first())

    assert stats(pattern="*.txt") == (2, 0, 3, 0)
    assert stats(pattern="*.txt") == (0, 2, 0, 0)
    assert (target / "d" / "ü b.txt").read_text() == "b" and not (target / "c.bin").exists()
    (source / "a.txt").write_text("aaa")
    (target / "extra").write_text("stays")
    assert stats() == (2, 1, 4, 0)
    assert stats(incremental=False) == (3, 0, 5, 0)
    assert stats(prefix="d/") == (0, 1, 0, 0)
    assert (target / "extra").exists() and not [p for p in target.rglob("*.partial")]


def test_mirror_reports_errors(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    source.mkdir()
    (source / "a").write_text("1")
    target.write_text("a file where a folder should be")
    result = mirror(spark, str(source), str(target), incremental=False)
    assert mirror_stats(result).first()["errors"] == 1 and mirror_errors(result).first()["key"] == "a"


def test_watch_sees_rewritten_objects(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    source.mkdir()
    (source / "a").write_text("1")
    events = []
    watch = Watch(spark, str(source), str(target))
    watch.poll(lambda name, n: events.append(name))
    (source / "a").write_text("22")
    (source / "b").write_text("3")
    watch.poll(lambda name, n: events.append(name))
    assert (target / "a").read_text() == "22" and (target / "b").read_text() == "3"
    assert events == ["initial_sync_complete", "sync_complete"]


@pytest.mark.parametrize("dialect", ["postgres", "oracle"])
def test_merge_statement_does_what_upsert_does(dialect):
    con = duckdb.connect()
    con.execute("create table t (id bigint primary key, v varchar, kept varchar)")
    con.execute("insert into t values (1, 'a', 'x'), (2, 'b', 'y')")
    con.execute("create table s as select * from (values (2, null), (3, 'c')) s(id, v)")
    con.execute(merge_statement("t", "s", ["id", "v"], "id", dialect))
    assert con.execute("select * from t order by id").fetchall() == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    con.execute(merge_statement("t", "s", ["id"], "id", dialect))
    assert con.execute("select count(*) from t").fetchone() == (3,)


def test_merge_statements():
    assert merge_statement("t", "s", ["id", "v"], "id", "postgres") == (
        'INSERT INTO "t" ("id", "v") SELECT "id", "v" FROM "s" WHERE TRUE ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v"'
    )
    assert "DO NOTHING" in merge_statement("t", "s", ["id"], "id", "postgres")
    assert "ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)" in merge_statement("t", "s", ["id", "v"], "id", "mysql")
    oracle = merge_statement("t", "s", ["id", "v"], "id", "oracle")
    assert oracle.startswith('MERGE INTO "t" t USING "s" s') and "WHEN NOT MATCHED" in oracle
    assert "WHEN MATCHED" not in merge_statement("t", "s", ["id"], "id", "oracle").replace("NOT MATCHED", "")
    with pytest.raises(ValueError):
        merge_statement("t; drop", "s", ["id"], "id", "postgres")
    assert "setval" in next_key_statement("t")
    types = column_types({"id": "BIGINT", "p": "DOUBLE PRECISION", "v": "TEXT"}, "mysql")
    assert types == "`id` BIGINT, `p` DOUBLE, `v` TEXT"
    assert table_query("a", "sqlserver", "dbo") == "SELECT * FROM [dbo].[a]"


def test_statements_around_a_merge():
    assert drop_statement("stage_1", "oracle") == 'DROP TABLE "stage_1"'
    assert key_statement("t", "id", "mysql") == "ALTER TABLE `t` ADD PRIMARY KEY (`id`)"
    with pytest.raises(ValueError):
        drop_statement("t; drop", "postgres")


def test_cells_that_cannot_be_read_are_rejected(spark, rows):
    bodies = ['{"id":"x"}', '[{"id":1},{"id":"bad"},{"id":null},{"other":2},5]', '{"data":[{"id":7}],"ok":true}', "[]", "12"]
    df = spark.createDataFrame([(f"r{i}", 200, 1, b) for i, b in enumerate(bodies)], "request_id string, status int, attempt int, body string")
    assert rows(responses.response_records(df, "id bigint")) == [("r1", None), ("r1", None), ("r1", 1), ("r2", 7)]
    assert rows(responses.response_rejects(df, "id bigint").select("request_id", "body")) == [("r0", '{"id":"x"}'), ("r1", "5"), ("r1", '{"id":"bad"}'), ("r4", "12")]
