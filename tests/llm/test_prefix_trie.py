import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tableferry.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, path string, words string, kind string, base string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, out = defaultdict(set), []
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ms in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(ms) - 1) * words
    for p, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if len(whole[c]) == len(p))))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(children[p]) if p in children else 0,
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = con.execute(prefix_trie.ORACLE)
    names = [d[0] for d in got.description]
    at = [names.index(c.split()[0]) for c in prefix_trie.NODE.split(", ")]
    return sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=str)


ODD = [
    (0, 0, "user", "a b c"), (0, 1, "bot", " d  e "), (0, 2, "user", "f"), (0, 3, "bot", "g h"), (0, None, "system", "first of all"),
    (1, 0, "user", "a b c"), (1, 1, "bot", " d  e "), (2, 0, "user", None), (3, 0, None, "x"), (3, 0, "a", "x"), (3, 0, "a", "x"),
    (4, 5, "user", ""), (21, 0, "user", "alone"), (25, 0, "user", "alone"), (26, 0, "user", "alone"), (27, 1, "u", "v"),
    (-5, 0, "user", "below"), (-45, 2, "user", "below"), (None, 0, "user", "nobody"), (None, 1, "user", "nobody"),
]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_rows_against_brute_force_and_sql(spark, shards):
    got = result(prefix_trie.prefix_trie(spark, frame(spark, ODD), shards=shards))
    assert got == brute(ODD)
    assert got == by_sql(ODD)


@pytest.mark.parametrize("shards", [1, 7])
def test_hot_and_long_conversations(spark, shards):
    """A third of all conversations are copies, others share long beginnings, and one is much longer than a band of columns."""
    rng, rows = random.Random(5), []
    for c in range(300):
        kind = c % 3
        length = 6 if kind == 0 else rng.randint(1, 9) if kind == 1 else rng.randint(1, 40)
        for t in range(length):
            text = f"same words {t}" if kind == 0 else f"word {rng.randint(0, 1)}" if kind == 1 else f"word {0 if t < 30 else c % 4}"
            rows.append((c, t, "user" if t % 2 else "bot", text))
    rows += [(1000, t, "user", f"long {t}") for t in range(200)] + [(1013, t, "user", f"long {t}") for t in range(150)]
    assert result(prefix_trie.prefix_trie(spark, frame(spark, rows), shards=shards)) == brute(rows)


def test_ends_of_one_path_fill_many_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_A_ROW", 3)
    rows = [(c, 0, "u", "same") for c in range(400, 480)]
    assert result(prefix_trie.prefix_trie(spark, frame(spark, rows), shards=5)) == brute(rows)


def test_no_rows(spark):
    empty = prefix_trie.prefix_trie(spark, frame(spark, []))
    assert empty.collect() == [] and [f"{n} {t}".replace("bigint", "long") for n, t in empty.dtypes] == prefix_trie.NODE.split(", ")
    assert prefix_trie.prefix_trie(spark, frame(spark, [(None, 0, "u", "x")])).collect() == []


def test_matrices_sort_like_tuples():
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 2, rng.integers(0, 50)).tolist() for _ in range(200)] + [[0] * 70, [0] * 70, [0] * 71]
    conv = rng.permutation(len(rows))
    lengths = np.array([len(r) for r in rows])
    turns, at = np.concatenate(rows).astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]]
    order = prefix_trie.in_order(turns, at, lengths, conv)
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], conv[i]))
    fresh = prefix_trie.first_new(turns, at[order], lengths[order])
    ordered = [rows[i] for i in order]
    for i in range(1, len(rows)):
        common = 0
        while common < min(len(ordered[i]), len(ordered[i - 1])) and ordered[i][common] == ordered[i - 1][common]:
            common += 1
        assert fresh[i] == common + 1
