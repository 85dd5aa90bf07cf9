import re
from collections import defaultdict

import oracle
import pytest
from pyspark.sql import functions as F

from tableferry.llm import exact, mixing
from tableferry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), QUERIES[name], ORACLES[name], SF) is None


ROWS = [(5, "a  b"), (3, "a\tb"), (4, None), (1, ""), (2, " a b"), (7, "c"), (7, "c"), (None, "c"), (None, "d"), (9, "x" * 200_000)]


def groups(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


WANTED = sorted(
    [(5, 3, 2, False), (3, 3, 2, True), (4, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (7, 7, 3, True), (7, 7, 3, True)]
    + [(None, 7, 3, False), (None, None, 1, True), (9, 9, 1, True)],
    key=str,
)


def test_exact_groups(spark, docs):
    assert groups(exact.exact_groups(spark, docs(ROWS))) == WANTED


def test_exact_groups_under_one_digest(spark, docs):
    """Texts that share a digest are told apart by their content, salted or not."""
    one = lambda _: F.lit("same")
    assert groups(exact.exact_groups(spark, docs(ROWS), one)) == WANTED
    few = lambda text: F.substring(text, 1, 1)
    assert groups(exact.exact_groups(spark, docs(ROWS), few, salts=3)) == WANTED


def test_drop_copies(spark, docs):
    df = docs(ROWS)
    kept = exact.drop_copies(spark, df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 7, 9, None]
    assert exact.drop_copies(spark, df.limit(0)).count() == 0 and exact.exact_groups(spark, df.limit(0)).count() == 0


def filled(sizes, epochs=3):
    """Water-filling by hand: clamp, share the rest out, until nothing is above its clamp."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        rest = total - sum(full.values())
        open_weight = sum(weight[s] for s in order if s not in full)
        over = [s for s in order if s not in full and weight[s] * rest / open_weight >= epochs * sizes[s]] if open_weight else []
        if not over:
            break
        full |= {s: float(epochs * sizes[s]) for s in over}
    return {s: full.get(s, weight[s] * rest / open_weight if open_weight else 0.0) for s in order}


def mixed(spark, rows):
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id bigint, text string, source string, size string")
    return df, mixing.mix(spark, df)


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 40 + 1), "big") for i in range(300)]
    rows += [(1000 + i, "w " * 10, "small") for i in range(4)] + [(2000, None, "none"), (2001, "a b", None), (2001, "a b", None)]
    rows += [(3000, "v " * 5000, "tail"), (3001, "", "tail")]
    df, plan = mixed(spark, rows)
    got = plan.collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    goal = filled(sizes)
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = {str(r) for r in mixing.mix(spark, df.repartition(3)).collect()}
    assert again == {str(r) for r in got}
    written = mixing.repeat_documents(spark, df).select("source", "text").collect()
    words = defaultdict(int)
    for r in written:
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert all(abs(words[s] - taken[s]) <= 2 for s in sizes)


def test_mix_of_nothing(spark):
    _, plan = mixed(spark, [])
    assert plan.count() == 0
    df, plan = mixed(spark, [(1, None, None), (2, " ", "a")])
    assert sorted((r["taken"], r["target"]) for r in plan.collect()) == [(0, 0.0), (0, 0.0)]
    assert mixing.repeat_documents(spark, df).count() == 0


def test_repeated_documents_keep_columns_of_any_name(spark, docs):
    df = docs(["one two three", "four five", None, "six " * 30])
    back = mixing.repeat_documents(spark, df)
    assert back.columns == df.columns and {r["__key"] for r in back.select("__key").collect()} == {"x"}
