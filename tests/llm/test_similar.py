import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableferry.llm import blocks, jaccard, paragraphs, store, vectors
from tableferry.llm.components import components
from tableferry.llm.shingles import shingle_set, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def united(nodes, links):
    low = {i: i for i in nodes}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        low[max(x, y)] = min(x, y)
    return {i: top(i) for i in nodes}


def brute(texts):
    sets = {i: shingles(t) for i, t in texts}
    shared, lists = Counter(), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            shared.update((j, i) for j in lists[x])
            lists[x].append(i)
    links = [p for p, n in shared.items() if 100 * n >= 80 * len(sets[p[0]] | sets[p[1]])]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), united(sets, links).values())}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = united({x for p in links for x in p}, links)
    assert got == want
    assert components(spark, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shingles_are_those_of_the_words():
    texts = ["A b\tc\x0bD e f", "a B c d E f", "ß É x y z", "one", "", None, "w" * 200 + " " + "w" * 201 + " a b c", " a b c d e"]
    for t in texts:
        assert len(shingle_set(t)) == len(shingles(t))
    assert (shingle_set(texts[0]) == shingle_set(texts[1])).all()
    assert len(set(word_hashes("ab ba a b aab " + "x" * 64 + " " + "x" * 128).tolist())) == 7


def test_linked_sets_share_a_key():
    """For every size, the least similar linked sets still meet under a key, whatever is small and what is large."""
    random.seed(3)
    for light in (0, 4, 9, 14, 30):
        for size in [*range(1, 40), 77, 150]:
            for extra in {0, 1, size // 4}:
                for _ in range(4):
                    pool = random.sample(range(1 << 20), size + extra + 50)
                    a = set(pool[:size])
                    union_most = size + extra
                    least = -(-80 * union_most // 100)
                    if least > size or extra == 0 and size == least:
                        continue
                    b = set(random.sample(sorted(a), least)) | set(pool[size : size + extra])
                    if a == b or 100 * len(a & b) < 80 * len(a | b):
                        continue
                    keys = [set(jaccard.set_keys(np.array(sorted(s), np.uint64), light).tolist()) for s in (a, b)]
                    assert keys[0] & keys[1], (light, size, extra)


def test_bitmaps_never_drop_a_link():
    rng = np.random.default_rng(1)
    for size in (5, 60, 900, 5000, 40_000):
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        cut = len(a) // 9
        b = np.unique(np.r_[a[cut:], rng.integers(0, 1 << 63, cut, np.uint64)])
        common = len(np.intersect1d(a, b))
        linked = 100 * common >= 80 * (len(a) + len(b) - common)
        bits = jaccard.Bitmaps([jaccard.bitmap(a), jaccard.bitmap(b), jaccard.bitmap(rng.integers(0, 1 << 63, size, np.uint64))])
        sizes = np.array([len(a), len(b), size])
        assert linked and bits.may_link(sizes, np.array([0]), np.array([1]), (100, 80))[0]
        if size > 50:
            assert not bits.may_link(sizes, np.array([0]), np.array([2]), (100, 80))[0]


def near_copies(count, words, changes, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(count):
        own = list(base)
        for _ in range(rng.randrange(changes + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = near_copies(40, 120, 4, 1) + near_copies(12, 11, 1, 2) + near_copies(6, 3000, 60, 3)
    rows += ["a b c d e f g h", "a b c d e f g h i", "A  b\nc d e f g h", "one two", "One\ttwo", "one two three", "one", "", None, "  "]
    rows += [" ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    rows += ["the same line of ten words stands in all these texts " + f"u{i} q{i} r{i}" for i in range(25)]
    return list(enumerate(rows))


def test_jaccard_join_against_brute_force(spark, docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark, docs(texts)).collect()}
    assert got == brute(texts)


def test_jaccard_join_of_odd_rows(spark, docs):
    rows = [(1, "a b c d e f"), (1, "z y x w v"), (2, "A B C D E F"), (None, "a b c d e f"), (None, None), (3, None), (3, "")]
    got = sorted((str(tuple(r)) for r in jaccard.near_duplicates(spark, docs(rows)).collect()))
    want = [(1, 2, 1), (1, 1, 1), (2, 2, 1), (None, 2, None), (None, 0, None), (3, 0, 3), (3, 0, 3)]
    assert got == sorted(map(str, want))
    assert jaccard.near_duplicates(spark, docs([])).count() == 0
    df = docs(rows)
    kept = jaccard.keep_one(spark, df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 1, 3, 3, None, None]


def test_long_lists_are_compared_in_parts(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark, docs(texts)).collect()}
    assert got == brute(texts)


def test_repeated_passages(spark, docs):
    rng = random.Random(9)

    def prose(n):
        return " ".join(f"p{rng.randrange(10**7)}" for _ in range(n))

    passage, line = prose(52), [f"l{rng.randrange(10**6)}" for _ in range(60)]
    other = list(line)
    other[30] = "changed"
    rows = [
        (1, prose(80)), (2, prose(30) + " " + passage + " " + prose(40)), (3, prose(7) + " " + passage), (4, passage.upper()),
        (5, prose(20) + "\n" + " ".join(line) + "\n" + prose(9)), (6, " ".join(other)), (7, None), (8, ""), (None, passage),
        (9, "short line\n" + prose(50)), (10, "short line\n" + prose(50)), (11, (prose(1) + " ") * 300), (12, "x " * 40),
    ]
    got = paragraphs.repeated_passages(spark, docs(rows)).collect()
    assert {r["doc_id"] for r in got} == {2, 3, 4, 5, 6}
    assert {r["doc_id"] for r in got if r["kept"]} == {2, 5}
    spans = {r["doc_id"]: (r["first_word"], r["last_word"]) for r in got}
    assert 30 <= spans[2][0] and spans[2][1] <= 82 and spans[6] == (0, 60) and spans[5] == (20, 80)
    assert paragraphs.repeated_passages(spark, docs([])).count() == 0


def test_every_repeated_paragraph_is_kept_once(spark, docs):
    """A header of one document opens two others that share what follows; a stretch runs over from a line into the next."""
    rng = random.Random(21)

    def prose(n):
        return " ".join(f"k{rng.randrange(10**7)}" for _ in range(n))

    head, body, tail = prose(30), prose(60), prose(70)
    rows = [
        (1, head + "\n" + prose(40)), (5, head + "\n" + body), (9, head + "\n" + body), (11, body + " " + tail), (12, prose(9) + "\n" + body + " " + tail),
    ]
    got = paragraphs.repeated_passages(spark, docs(rows)).collect()
    texts = {i: t.split() for i, t in rows}
    stays = {i: [True] * len(t) for i, t in texts.items()}
    kept = {i: [False] * len(t) for i, t in texts.items()}
    for r in got:
        for at in range(r["first_word"], r["last_word"]):
            kept[r["doc_id"]][at] |= r["kept"]
            stays[r["doc_id"]][at] &= r["kept"]
    assert all(s or not k for i in texts for s, k in zip(stays[i], kept[i]))
    left = [" ".join(w for w, s in zip(texts[i], stays[i]) if s) for i in texts]
    assert [sum(p in t for t in left) for p in (head, body, tail)] == [1, 1, 1]
    spans = {(r["doc_id"], r["first_word"], r["last_word"], r["keep_doc_id"]) for r in got}
    assert {(1, 0, 30, 1), (5, 0, 30, 1), (5, 30, 90, 5), (9, 0, 30, 1)} <= spans


@pytest.mark.parametrize("part", [2048, 7])
def test_lines_meet_without_the_leader_of_their_band(spark, docs, monkeypatch, part):
    """Variants of one line, of which few are similar enough; the pairs planted among them differ in the middle word."""
    monkeypatch.setattr(paragraphs, "PART", part)
    rng = random.Random(12)
    base = [f"b{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for _ in range(60):
        own = list(base)
        for at in (rng.randrange(4, 20), rng.randrange(40, 56)):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append(own)
    for own in rows[:40]:
        twin = list(own)
        twin[30] = f"y{rng.randrange(10**6)}"
        rows.append(twin)
    rows = [(i, " ".join(own)) for i, own in enumerate(rows)]
    df = docs(rows)
    df = df.select("doc_id", "text")
    classes = paragraphs._classes(spark, paragraphs._units(spark, df))
    banded = paragraphs._banded(spark, classes)
    whole = paragraphs._bodies(spark, df, classes, banded)
    stars = banded.filter("class <> leader").selectExpr("class as a", "leader as b").distinct()
    links = paragraphs._confirmed(spark, whole, stars)
    rest = paragraphs._across(spark, banded, whole, links)
    found = {r["node"]: r["component"] for r in components(spark, rest).collect()}
    first = {r["node"]: r["component"] for r in components(spark, links).collect()}
    name = {i: int(paragraphs.names_of(paragraphs.line_shingles(t)[2]).view(np.int64)[0]) for i, t in rows}
    sets = {i: shingles(t) for i, t in rows}
    linked = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    keys = {i: set(paragraphs.bands(paragraphs.line_shingles(t)[2])[0].tolist()) for i, t in rows}
    linked = [(i, j) for i, j in linked if keys[i] & keys[j]]
    together = [sum(c.get(name[i], i) == c.get(name[j], -1 - j) for i, j in linked) for c in (first, found)]
    assert len(linked) >= 35 and together[0] < len(linked) == together[1]


def test_band_entries_are_shuffled_once(spark, docs, monkeypatch):
    """Where no side of a join is small, as with large tables, each entry of a band still travels once, not for a count and for a join."""
    plans, write = [], paragraphs.staged

    def noted(session, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(session, df, name)

    monkeypatch.setattr(paragraphs, "small", lambda session, df, stored: df)
    rows = docs(near_copies(20, 60, 2, 7)).select("doc_id", "text")
    classes = paragraphs._classes(spark, paragraphs._units(spark, rows))
    monkeypatch.setattr(paragraphs, "staged", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not paragraphs._banded(spark, classes).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(plan.count("Exchange hashpartitioning(key") for plan in plans) == 1


@pytest.mark.parametrize("least", [5, 10**6])
def test_crowded_groups_are_told_like_others(spark, monkeypatch, least):
    monkeypatch.setattr(blocks, "LEAST", least)
    rng = random.Random(4)
    rows = [(rng.randrange(1 << 62), i % 7, i) for i in range(300)] + [(77, i % 2, i) for i in range(60)] + [(78, 0, 5)] * 40
    rows += [(rows[i][0], rows[i][1], 900 + i) for i in range(0, 300, 10)]
    df = spark.createDataFrame(rows, "name long, check int, doc_id long")
    assert set(blocks.crowded(df, "name")) == ({77, 78} if least == 5 else set())
    told = {"low": F.min("doc_id"), "high": F.max("doc_id")}
    got = sorted(tuple(r) for r in blocks.told_groups(df, ["name", "check"], told, "low <> high").select("name", "check", "doc_id", "low", "high").collect())
    held = {}
    for name, check, doc_id in rows:
        held.setdefault((name, check), []).append(doc_id)
    assert got == sorted((*k, d, min(v), max(v)) for k, v in held.items() if min(v) != max(v) for d in v)


@pytest.mark.parametrize("words", [1 << 18, 1])
def test_thinned_rows_hold_all_partners(spark, monkeypatch, words):
    monkeypatch.setattr(store, "WORDS", words)
    rows = spark.range(-2000, 2000).selectExpr("id as k", "id * 2 as v").unionByName(spark.sql("select cast(null as bigint) as k, 0L as v"))
    keys = spark.range(-300, 300, 20).toDF("k")
    got = store.thinned(rows, keys)
    assert got.columns == rows.columns
    left = {r["k"] for r in got.collect()}
    assert set(range(-300, 300, 20)) <= left and (words == 1 or len(left) < 600)
    assert store.thinned(rows, keys.limit(0)).count() == 0


def test_repeated_rows_of_a_document_change_nothing(spark, docs):
    """A doc_id with several rows, and a row that holds a line twice; each line's set is read once all the same."""
    lines = near_copies(12, 60, 2, 8)
    rows = [(i, t) for i, t in enumerate(lines)] + [(50, lines[3] + "\n" + lines[4] + "\n" + lines[3])]
    df = docs(rows + rows[:6] + rows[-1:]).select("doc_id", "text")
    classes = paragraphs._classes(spark, paragraphs._units(spark, df))
    whole = paragraphs._bodies(spark, df, classes, paragraphs._banded(spark, classes))
    assert whole.count() == whole.select("class").distinct().count() == len(set(lines))
    once, twice = (sorted(tuple(r) for r in paragraphs.repeated_passages(spark, docs(x)).collect()) for x in (rows, rows + rows[:6] + rows[-1:]))
    assert once and set(once) == set(twice)


def test_every_run_of_fifty_words_shares_a_stretch():
    rng = np.random.default_rng(2)
    for _ in range(200):
        run = rng.integers(0, 1 << 63, 50, np.uint64)
        names = []
        for _ in range(2):
            text = np.r_[rng.integers(0, 1 << 63, rng.integers(0, 60), np.uint64), run, rng.integers(0, 1 << 63, rng.integers(0, 60), np.uint64)]
            names.append(set(paragraphs.stretches(text)[1].tolist()))
        assert names[0] & names[1]


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows, at = [], 0
    for c in centres:
        for _ in range(5):
            rows.append((at, (c + rng.standard_normal(16) * 0.05 * rng.integers(1, 4)).tolist(), int(at % 3)))
            at += 1
    hot = rng.standard_normal(16)
    rows += [(1000 + i, (hot + rng.standard_normal(16) * 0.02).tolist(), 0) for i in range(60)]
    rows += [(2000 + i, hot.tolist(), 0) for i in range(5)] + [(2100, (hot * 7).tolist(), 0), (2101, hot.tolist(), 1)]
    odd = [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, hot.tolist(), None), (3004, [None] * 16, 0)]
    odd += [(3005, [float("inf")] * 16, 0), (3006, [], 0), (3007, [1.0], 0), (None, [1.0, 2.0], 9)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as uid", "2 as key")
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark, df).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels, ids = np.array([r[2] for r in rows]), [r[0] for r in rows]
    a, b = np.where(np.triu((x @ x.T >= 0.93) & (labels[:, None] == labels), 1))
    count = Counter(ids[i] for i in [*a, *b])
    found = sum(got[i]["n_links"] for i in ids)
    assert 0.97 * sum(count.values()) <= found <= sum(count.values())
    assert all(got[i]["n_links"] <= count[i] for i in ids)
    want = united(ids, [(ids[i], ids[j]) for i, j in zip(a, b)])
    assert sum(got[i]["component_id"] == want[i] for i in ids) >= 0.97 * len(ids)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)
    for i, *_ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(rows) + len(odd)
    assert vectors.near_vectors(spark, df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def variants():
    """Variants of one text of 60 words, one word changed in each: many pairs link, and few with any one of them."""

    def make(count):
        rng, base = random.Random(8), [f"w{i}" for i in range(60)]
        return [" ".join(base[:at] + [f"x{i}"] + base[at + 1 :]) for i in range(count) for at in [rng.randrange(60)]]

    return make


def test_pairs_of_a_group_grow_with_its_size(spark, docs, variants, monkeypatch):
    named, checked = [], jaccard.verified

    def counted(spark, docs, sets, pairs, needed=jaccard.NEEDED):
        named[-1] += pairs.count()
        return checked(spark, docs, sets, pairs, needed)

    monkeypatch.setattr(jaccard, "verified", counted)
    for count in (300, 600):
        texts = variants(count)
        named.append(0)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark, docs(texts)).collect()}
        assert got == brute(list(enumerate(texts)))
        # Each set of 56 shingles has 12 keys at most, and two pairs from the stars.
        assert named[-1] <= 14 * count


def test_pairs_of_similar_lines_grow_with_their_number(spark, docs, variants, monkeypatch):
    """Variants of one line, in as many documents: few pairs are checked, and all that share a band end up in one component."""
    named, checked = [], paragraphs._confirmed

    def counted(spark, whole, pairs):
        named[-1] += pairs.count()
        return checked(spark, whole, pairs)

    monkeypatch.setattr(paragraphs, "_confirmed", counted)
    for count in (300, 600):
        texts = variants(count)
        named.append(0)
        got = paragraphs.repeated_passages(spark, docs(texts)).collect()
        keys = [paragraphs.bands(paragraphs.line_shingles(t)[2])[0].tolist() for t in texts]
        sets, lists = [shingles(t) for t in texts], defaultdict(set)
        for i, own in enumerate(keys):
            for k in own:
                lists[k].add(i)
        links = {(i, j) for own in lists.values() for i in own for j in own if j < i}
        links = [(i, j) for i, j in links if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        want = united(range(count), links)
        sizes = Counter(want.values())
        lows = {(r["doc_id"], r["keep_doc_id"]) for r in got if r["n_words"] == 60}
        assert {(i, c) for i, c in want.items() if sizes[c] > 1} <= lows
        # A line has a pair with the leader of each band at most, and one in each band that still holds other components.
        assert named[-1] <= 2 * paragraphs.BANDS * count
    assert named[1] <= 2.5 * named[0]


def test_pairs_that_do_not_hold_are_all_looked_at(spark, docs, variants, monkeypatch):
    """Bitmaps of few places let pass pairs that the whole sets refuse; lists are then read several times, and no link is lost."""
    monkeypatch.setattr(jaccard, "BITS", 64)
    monkeypatch.setattr(jaccard, "MOST_BITS", 64)
    rng = random.Random(2)
    texts = variants(150)
    texts += [" ".join(t.split()[:20] + [f"y{rng.randrange(40)}" for _ in range(12)] + t.split()[32:]) for t in texts[:80]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark, docs(texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_spanning_pairs_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 60, (2, 90))
    a, b = a[a != b], b[a != b]
    label = rng.integers(0, 50, 60) * 7
    some = jaccard.spanning(a, b, label)
    own = lambda x, y: united(sorted(set(label.tolist())), list(zip(label[x].tolist(), label[y].tolist())))
    assert own(a[some], b[some]) == own(a, b)
    assert len(some) == len(set(label.tolist())) - len(set(own(a, b).values()))
