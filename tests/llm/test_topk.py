import math
import random

import numpy as np
import pytest

from tableferry.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, uid string, number string, cell string, dims string, score string"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA.replace("float", kind))


def brute(rows, k=20, step=20):
    whole = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(64 * x) for x in v):
            whole.append((at, i, [math.floor(64 * x) for x in v]))
    out = []
    for at, i, v in whole:
        if i is not None and i % step == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for other, j, w in whole if other != at and len(w) == len(v)]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def exact(x):
    return [float(np.float32(a)) for a in x]


@pytest.mark.parametrize("sizes", [(2048, 4096, 2048), (16, 8, 32)])
def test_clustered_rows_with_a_hot_vector(spark, sizes):
    rng = random.Random(4)
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(420):
        middle = middles[rng.randrange(6)]
        rows.append((i, exact([0.5] * 8 if i % 3 == 0 else [m + rng.gauss(0, 0.05) for m in middle])))
    data, query, cell = sizes
    got = topk.nearest_neighbours(spark, frame(spark, rows), data_block=data, query_block=query, cell_rows=cell)
    assert result(got) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]),
        (80, [float("inf"), 1.0]), (100, []), (120, []), (140, [1.0, 2.0, 3.0]), (160, [0.0, 0.0]), (-20, [-0.01, -1.5]), (3, [-3.0, 0.3]),
        (180, [1e4, -1e4]), (200, [3e30, 1.0]), (201, [2.0, 3e30]), (4, [1.0, 2.0, 2.5]),
    ]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = result(topk.nearest_neighbours(spark, frame(spark, rows)))
    want = sorted(((q, r, v, min(max(s, -(2**63) + 1), 2**63 - 1)) for q, r, v, s in brute(rows)), key=str)
    assert [g for g in got if g[0] not in (200, 0)] == [w for w in want if w[0] not in (200, 0)]
    # Scores that are cut to 64 bits tie, and go by vec_id.
    assert {g for g in got if g[0] in (200, 0) and abs(g[3]) < 2**62} == {w for w in want if w[0] in (200, 0) and abs(w[3]) < 2**62}


def test_double_components_and_fewer_rows_than_k(spark):
    rows = [(i, [i / 3 - 1, 1e-9 * i, 700.0 * i]) for i in range(0, 50, 5)]
    assert result(topk.nearest_neighbours(spark, frame(spark, rows, "double"))) == brute(rows)


def test_no_rows_and_no_queries(spark):
    empty = topk.nearest_neighbours(spark, frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.nearest_neighbours(spark, frame(spark, [(1, [1.0]), (None, [1.0])])).collect() == []


def test_far_groups_are_not_sent():
    """A query at one end of the space needs the group there only."""
    pivots = np.array([[1000.0, 0], [-1000.0, 0], [0, 10.0]])
    groups = topk.Groups(pivots, np.full(3, 5.0), np.array([1005.0, 1005.0, 15.0]), np.arange(3), np.array([1, 1, 1]))
    bounds = groups.bounds(np.array([[900.0, 0.0]]))[0]
    assert bounds[0] > 900_000 > bounds[2] > bounds[1]
    assert groups.bounds(np.array([[0.0, 0.0]])).max() <= 1


def test_inner_products_are_exact():
    a = np.array([[2.0**40, 1.0], [3.0, 5.0]])
    b = np.array([[2.0**40, 1.0], [2.0**21, 2.0]])
    assert topk.inner(a, b).tolist() == [[2**63 - 1, 2**61 + 2], [3 * 2**40 + 5, 3 * 2**21 + 10]]
    assert topk.inner(a[1:], b[1:]).dtype == np.float32 or topk.inner(a[1:], b[1:]).dtype == np.float64
