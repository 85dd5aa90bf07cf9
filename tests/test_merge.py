from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plans import plan_of
from tableferry.operators.compare import compare
from tableferry.operators.dedupe import latest_per_key, one_per_key
from tableferry.operators.documents import document_upsert, document_upsert_counts, to_document
from tableferry.operators.merge import insert_skip, merge_counts, project_to, staged_upsert, upsert
from tableferry.operators.tables import BucketedTable, VersionedTable
from tableferry.session import scratch_dir

TARGET = "k bigint, v string, only_t string"
SOURCE = "k bigint, v string, seq int, only_s string"
TARGET_ROWS = [(1, "a", "t1"), (2, "b", "t2"), (3, "", "t3"), (None, "n", "tn")]
SOURCE_ROWS = [
    (1, "late", 2, "s"),
    (1, "early", 1, "s"),
    (2, None, 1, "s"),
    (4, "new", 1, "s"),
    (None, "x", 1, "s"),
    (None, "x", 1, "s"),
]


def frames(spark, target=TARGET_ROWS, source=SOURCE_ROWS):
    return spark.createDataFrame(target, TARGET), spark.createDataFrame(source, SOURCE)


UPSERTED = [
    (None, "n", "tn", None, None),
    (None, "x", None, 1, "s"),
    (None, "x", None, 1, "s"),
    (1, "late", "t1", 2, "s"),
    (2, None, "t2", 1, "s"),
    (3, "", "t3", None, None),
    (4, "new", None, 1, "s"),
]


@pytest.mark.parametrize("form", ["unique", "any", "small", "staged", "staged_large", "versioned", "bucketed"])
def test_upsert_forms(spark, rows, form):
    t, s = frames(spark)
    if form == "staged":
        out = staged_upsert(t, s, "k", ["seq"])
    elif form == "staged_large":
        out = staged_upsert(t, s, "k", ["seq"], broadcast_bytes=0)
    elif form == "versioned":
        table = VersionedTable(spark, scratch_dir(spark, "v"))
        table.commit(t)
        out = table.upsert(s, "k", ["seq"])
    elif form == "bucketed":
        table = BucketedTable(spark, scratch_dir(spark, "b"), "k", 4)
        table.create(t)
        table.upsert(s, ["seq"])
        out = table.read()
    else:
        merge = staged_upsert if form == "small" else upsert
        out = merge(t, s, "k", ["seq"], target_unique=form == "unique")
    assert rows(out.select("k", "v", "only_t", "seq", "only_s")) == sorted(
        UPSERTED, key=lambda r: [(v is not None, str(v)) for v in r]
    )


def test_duplicate_target_keys_are_all_updated(spark, rows):
    t, s = frames(spark, [(1, "a", "x"), (1, "b", "y")], [(1, "new", 1, "s"), (5, "five", 1, "s")])
    want = [(1, "new", "x"), (1, "new", "y"), (5, "five", None)]
    for small in (False, True):
        out = (staged_upsert if small else upsert)(t, s, "k", ["seq"])
        assert rows(out.select("k", "v", "only_t")) == sorted(want, key=lambda r: [(v is not None, str(v)) for v in r])


def test_empty_sides(spark):
    t, s = frames(spark)
    assert upsert(t, s.limit(0), "k", ["seq"]).count() == 4
    assert upsert(t.limit(0), s, "k", ["seq"]).count() == 5
    assert insert_skip(t, s.limit(0), "k", ["seq"]).count() == 4


def test_key_only_source_does_not_fail(spark, rows):
    t = spark.createDataFrame([(1,), (2,)], "k bigint")
    s = spark.createDataFrame([(2,), (3,), (3,)], "k bigint")
    assert rows(upsert(t, s, "k", [])) == [(1,), (2,), (3,)]


def test_insert_skip(spark, rows):
    t, s = frames(spark)
    out = insert_skip(t, s, "k", ["seq"], with_action=True)
    assert rows(out.filter("_action = 'kept'").select(t.columns)) == rows(t)
    assert rows(out.filter("_action = 'inserted'").select("k", "v")) == [(None, "x"), (None, "x"), (4, "new")]
    assert insert_skip(t, s).count() == 10


def test_counts(spark):
    t, s = frames(spark)
    got = merge_counts(upsert(t, s, "k", ["seq"], with_action=True)).first()
    assert (got["inserted"], got["updated"], got["kept"]) == (3, 2, 2)


def test_first_and_last_differ_on_ties_by_all_columns(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 1)], "k bigint, v string, seq int")
    assert one_per_key(df, "k", ["seq"], "first").first()["v"] == "a"
    assert one_per_key(df, "k", ["seq"], "last").first()["v"] == "b"
    mapped = df.withColumn("m", F.create_map("v", "seq"))
    assert one_per_key(mapped, "k", ["seq"]).first()["m"] == {"b": 1}
    assert latest_per_key(df.withColumn("k", F.lit(None).cast("bigint")), "k", ["seq"]).count() == 2


def test_upsert_matches_names_as_the_session_does(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    s = spark.createDataFrame([(1, "z")], "K bigint, V string")
    merged = upsert(t, s, "k", [], target_unique=True)
    assert merged.columns == ["k", "v"]
    assert {tuple(r) for r in merged.collect()} == {(1, "z"), (2, "b")}


def test_project_to(spark):
    df = project_to(spark.sql("select 1 a, 2 b"), ["b", "c"])
    assert df.columns == ["b", "c"] and tuple(df.first()) == (2, None)


keys = st.one_of(st.none(), st.integers(0, 4))
source_rows = st.lists(st.tuples(keys, st.sampled_from(["a", "", None]), st.integers(0, 9)), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.integers(0, 4)), source_rows)
def test_upsert_properties(spark, held, incoming):
    t = spark.createDataFrame([(k, "old", k) for k in held], "k bigint, v string, extra bigint")
    s = spark.createDataFrame(incoming, "k bigint, v string, seq int")
    merged = upsert(t, s, "k", ["seq"])
    got = [tuple(r) for r in merged.select("k", "v", "extra").collect()]
    groups = defaultdict(list)
    for k, v, seq in incoming:
        groups[k].append((seq, v is not None, v or "", v))
    want = [(k, max(groups[k])[3] if k in groups else "old", k) for k in held]
    want += [(k, max(g)[3], None) for k, g in groups.items() if k is not None and k not in held]
    want += [(None, v, None) for k, v, _ in incoming if k is None]
    assert sorted(got, key=str) == sorted(want, key=str)
    keyed = s.filter("k is not null")
    once = upsert(t, keyed, "k", ["seq"])
    assert sorted(map(str, upsert(once, keyed, "k", ["seq"]).collect())) == sorted(map(str, once.collect()))


def test_versions_and_tags(spark):
    table = VersionedTable(spark, scratch_dir(spark, "v"))
    assert table.read() is None
    source = spark.createDataFrame([(None, "x", 1)], "k bigint, v string, seq int")
    table.upsert(source, "k", ["seq"], tag="q-0")
    table.upsert(source, "k", ["seq"], tag="q-0")
    assert table.read().count() == 1 and len(table.versions()) == 1
    table.upsert(source, "k", ["seq"], tag="q-1")
    assert table.read().count() == 2 and table.read(1).count() == 1
    assert table.expire(1) == 1 and table.read().count() == 2 and table.read(1) is None
    # A version without its success marker is not there.
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{table.path}/v=000000000009"
    )
    assert len(table.versions()) == 1


def test_bucketed_upsert_rewrites_only_hit_buckets(spark):
    table = BucketedTable(spark, scratch_dir(spark, "b"), "k", 16)
    table.create(spark.range(200).selectExpr("id as k", "'old' as v"))
    before = table.manifest()["folders"]
    hit = table.upsert(spark.createDataFrame([(7, "new", 1)], "k bigint, v string, seq int"), ["seq"])
    after = table.manifest()["folders"]
    assert len(hit) == 1 and {b for b in before if before[b] != after[b]} == {str(hit[0])}
    assert table.read().filter("v = 'new'").count() == 1 and table.read().count() == 200
    read = table._rows(table.manifest(), hit).inputFiles()
    assert read and all(f"_bucket={hit[0]}/" in f for f in read)
    assert table.expire(1) == 0 and table.read().count() == 200


def test_bucketed_upsert_of_an_unstable_source(spark):
    """A source that gives other rows each time it is evaluated must not empty buckets that were not read."""
    table = BucketedTable(spark, scratch_dir(spark, "b"), "k", 16)
    table.create(spark.range(1000).selectExpr("id as k", "0 as v"))
    source = spark.range(50).select(F.floor(F.rand() * 1000).alias("k"), F.lit(1).alias("v"))
    table.upsert(source, ["v"])
    assert table.read().select("k").distinct().count() == 1000


def test_bucketed_commit_that_breaks_off(spark, monkeypatch):
    table = BucketedTable(spark, scratch_dir(spark, "b"), "k", 4)
    table.create(spark.range(20).selectExpr("id as k", "'old' as v"))

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("tableferry.operators.tables.write_text", broken)
        with pytest.raises(RuntimeError):
            table.upsert(spark.range(20).selectExpr("id as k", "'new' as v"), [], tag="q-0")
    assert table.read().filter("v = 'old'").count() == 20
    table.upsert(spark.range(20).selectExpr("id as k", "'new' as v"), [], tag="q-0")
    assert table.read().filter("v = 'new'").count() == 20 and table.has_tag("q-0") and not table.has_tag("q-1")


def test_created_tables_hold_each_key_once(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 1), (None, "c", 1)], "k bigint, v string, seq int")
    table = BucketedTable(spark, scratch_dir(spark, "b"), "k", 4)
    table.create(rows, ["seq"])
    assert sorted(map(str, table.read().select("k", "v").collect())) == sorted(
        map(str, spark.sql("select 1L k, 'b' v union all select null, 'c' union all select null, 'c'").collect())
    )
    versions = VersionedTable(spark, scratch_dir(spark, "v"))
    versions.commit(rows)
    assert not versions.holds_once("k")
    merged = versions.upsert(spark.createDataFrame([(1, "z", 3)], rows.schema), "k", ["seq"])
    assert merged.filter("k = 1 and v = 'z'").count() == 2 and not versions.holds_once("k")
    fresh = VersionedTable(spark, scratch_dir(spark, "v"))
    fresh.upsert(rows, "k", ["seq"])
    assert fresh.holds_once("k") and not fresh.holds_once("v")


def test_bucketed_replay_adds_nothing(spark):
    table = BucketedTable(spark, scratch_dir(spark, "b"), "k", 4)
    table.create(spark.range(5).selectExpr("id as k", "'old' as v"))
    batch = spark.createDataFrame([(None, "x", 1), (None, "x", 1), (1, "new", 1)], "k bigint, v string, seq int")
    table.upsert(batch, ["seq"], tag="q-0")
    table.upsert(batch, ["seq"], tag="q-0")
    assert table.read().count() == 7
    table.upsert(batch, ["seq"], tag="q-1")
    assert table.read().count() == 9


def test_documents(spark):
    def docs(*items):
        df = spark.createDataFrame(list(enumerate(items)), "n int, j string")
        return df.select("n", to_document(F.col("j")).alias("doc"))

    held = docs('{"id":1,"a":1,"b":"x"}', '{"id":2,"a":5}', '{"z":1}').drop("n")
    news = docs('{"id":1,"b":null,"c":[1]}', '{"id":1,"a":2}', '{"a":9}', '{"id":3,"a":1}')
    got = {r["key"]: r["doc"] for r in document_upsert(held, news, "id", ["n"]).collect()}
    assert got == {
        "1": {"id": "1", "a": "2", "b": "null", "c": "[1]"},
        "2": {"id": "2", "a": "5"},
        "3": {"id": "3", "a": "1"},
        None: {"z": "1"},
    }
    assert tuple(document_upsert_counts(held, news, "id").first()) == (3, 1)


def test_documents_that_share_a_key(spark):
    """Of held documents with one key only the first changes; none of them is lost."""
    held = spark.createDataFrame([(1, '{"id":1,"a":1}'), (2, '{"id":1,"a":2}'), (3, '{"id":2,"a":3}'), (4, '{"id":2,"a":4}')], "n int, j string")
    held = held.select("n", to_document(F.col("j")).alias("doc"))
    news = spark.createDataFrame([(1, '{"id":1,"b":9}')], "n int, j string").select("n", to_document(F.col("j")).alias("doc"))
    got = sorted(sorted(r["doc"].items()) for r in document_upsert(held, news, "id", ["n"], target_order=["n"]).collect())
    assert got == [
        [("a", "1"), ("b", "9"), ("id", "1")],
        [("a", "2"), ("id", "1")],
        [("a", "3"), ("id", "2")],
        [("a", "4"), ("id", "2")],
    ]


@pytest.mark.parametrize("by_value", [False, True])
def test_compare(spark, by_value):
    s = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "x", 1), (4, "d", 1), (4, "d", 1), (None, "n", 1)], "k int, v string, w int")
    t = spark.createDataFrame([(1, "a", 1), (2, None, 2), (5, "x", 1), (4, "d", 1), (None, "n", 1)], "k int, v string, w int")
    got = {r["k"]: (r["class"], r["changed_columns"]) for r in compare(s, t, "k", by_value=by_value).collect()}
    assert got == {
        1: ("equal", None),
        2: ("changed", "w"),
        3: ("only_source", None),
        4: ("duplicate_key", None),
        5: ("only_target", None),
        None: ("equal", None),
    }


@pytest.mark.parametrize("by_value", [False, True])
def test_compare_takes_maps(spark, by_value):
    s = spark.sql("select * from values (1, map('a', 1, 'b', 2), array(map('x', 1))), (2, map('a', 1), null), (3, null, null) t(k, m, n)")
    t = spark.sql("select * from values (1, map('b', 2, 'a', 1), array(map('x', 1))), (2, map('a', 2), array()), (3, null, null) t(k, m, n)")
    got = {r["k"]: (r["class"], r["changed_columns"]) for r in compare(s, t, "k", by_value=by_value).collect()}
    assert got == {1: ("equal", None), 2: ("changed", "m, n"), 3: ("equal", None)}


def test_compare_by_value(spark):
    """A NULL on one side is a change, NaN equals NaN, 0.0 equals -0.0; no hash of a value is in the plan."""
    rows = "(1, 'a', double('NaN'), array(1)), (2, null, 0.0, null), (3, 'c', 1.0, array(1, 2)), (4, null, null, null)"
    s = spark.sql(f"select * from values {rows} t(k, v, d, l)")
    t = spark.sql("select * from values (1, 'a', double('NaN'), array(1)), (2, '', -0.0, array()), (3, null, 2.0, array(2, 1)), (4, null, null, null) t(k, v, d, l)")
    found = compare(s, t, "k", by_value=True)
    assert {r["k"]: (r["class"], r["changed_columns"]) for r in found.collect()} == {
        1: ("equal", None),
        2: ("changed", "v, l"),
        3: ("changed", "v, d, l"),
        4: ("equal", None),
    }
    assert "xxhash64" not in plan_of(found)
