"""Substring deduplication: MinHash bands of paragraphs, exact Jaccard, and removals by component.

A paragraph is a line of the text, or a stretch of ``STRETCH`` words that starts at an anchor inside it. Anchors are picked by
content (the smallest shingle hash of every ``WINDOW`` in a row), so that a passage copied into the middle of another
paragraph brings its own paragraphs along: every run of ``WINDOW + STRETCH + 4`` equal words, 50 here, holds a common one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableferry.llm.blocks import in_parts, pairs_in_blocks, told_groups, whole_blocks
from tableferry.llm.components import components
from tableferry.llm.jaccard import Bitmaps, bitmap, spanning
from tableferry.llm.shingles import SHINGLE, mixed, shingle_hashes, words_of
from tableferry.llm.store import sliced, small, staged, thinned

STRETCH, WINDOW = 26, 20
# At similarity 0.8 one of 10 bands of 3 agrees with probability 1 - (1 - 0.8**3) ** 10 = 0.999. A stretch copied word by word
# agrees in all its shingles and has one band of all of them.
BANDS, ROWS = 10, 3
KEYS = [f"key{k}" for k in range(BANDS)]
NEEDED = (100, 80)
# Lines of a band that are compared with each other in one task; longer bands are cut into pairs of such parts.
PART = 2048
_RANDOM = np.random.default_rng(31)
_TURNS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, np.uint64)
_STEPS = _RANDOM.integers(1, 1 << 63, (2, STRETCH), np.uint64) * np.uint64(2) + np.uint64(1)


def stretches(words: np.ndarray, shingles: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchored stretches of a text: first words, and two independent hashes of their words."""
    shingles = shingle_hashes(words) if shingles is None else shingles
    if len(words) < STRETCH or len(shingles) < WINDOW:
        empty = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), empty, empty
    rows = np.lib.stride_tricks.sliding_window_view(shingles, WINDOW)
    at = np.unique(rows.argmin(axis=1) + np.arange(len(rows)))
    at = at[at + STRETCH <= len(words)]
    own = words[at[:, None] + np.arange(STRETCH)]
    return at, mixed((own * _STEPS[0]).sum(axis=1, dtype=np.uint64)), mixed((own * _STEPS[1]).sum(axis=1, dtype=np.uint64))


def runs(at: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last (exclusive) word, and the hashes, of stretches; equal ones that overlap, as in a word said over and
    over, are one run."""
    order = np.lexsort((at, one))
    at, one, two = at[order], one[order], two[order]
    opens = np.r_[True, (one[1:] != one[:-1]) | (at[1:] > at[:-1] + STRETCH)][: len(at)]
    first = np.flatnonzero(opens)
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    return at[first], at[last] + STRETCH, one[first], two[first]


def lines(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) word of each line of at least ``STRETCH`` words."""
    edges = np.r_[0, np.searchsorted(starts, np.flatnonzero(raw == 10)), len(starts)]
    first, last = edges[:-1], edges[1:]
    long = last - first >= STRETCH
    return first[long], last[long]


def inside(shingles: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """The shingles of each line, which are those of the text that lie inside it."""
    return [shingles[a : b - SHINGLE + 1] for a, b in zip(first.tolist(), last.tolist())]


def line_shingles(text: str | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First and last word of each long line, and its shingles."""
    raw, starts, words = words_of(text)
    first, last = lines(raw, starts)
    return first, last, inside(shingle_hashes(words), first, last) if len(first) else []


def names_of(shingles: list[np.ndarray]) -> np.ndarray:
    """One number for the shingles of each line, in any order."""
    sizes = np.array([len(s) for s in shingles], np.int64)
    sums = np.add.reduceat(np.concatenate(shingles), np.r_[0, np.cumsum(sizes)[:-1]])
    return mixed(sums + sizes.astype(np.uint64))


def bands(shingles: list[np.ndarray]) -> np.ndarray:
    """Band keys of each line, over the lines of many texts at once."""
    starts = np.r_[0, np.cumsum([len(s) for s in shingles])[:-1]].astype(np.int64)
    flat = np.concatenate(shingles)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        low = np.minimum.reduceat(flat * _TURNS[i] + _SHIFTS[i], starts)
        keys[:, i // ROWS] = mixed(keys[:, i // ROWS] * np.uint64(3) + low)
    return keys + np.arange(BANDS, dtype=np.uint64)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _units(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All paragraphs, from one pass over the texts. A stretch has a ``check``, a line has its band keys."""
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parts, held = [], []
            for text in batch.column(1).to_pylist():
                raw, starts, words = words_of(text)
                shingles = shingle_hashes(words)
                first, last = lines(raw, starts) if len(words) else nothing
                parts.append(runs(*stretches(words, shingles)))
                held.append((first, last, inside(shingles, first, last)))
            copies = [len(p[0]) for p in parts]
            counts = [len(h[0]) for h in held]
            total = sum(copies), sum(counts)
            if not sum(total):
                continue
            at = np.arange(len(parts))
            ids = batch.column(0).take(pa.array(np.r_[np.repeat(at, copies), np.repeat(at, counts)]))
            places = [pa.array(np.concatenate([p[k] for p in parts] + [h[k] for h in held]).astype(np.int32)) for k in (0, 1)]
            own = [s for *_, found in held for s in found]
            names = np.concatenate([p[2] for p in parts] + ([names_of(own)] if own else []))
            checks = pa.array((np.concatenate([p[3] for p in parts]) >> np.uint64(33)).astype(np.int32))
            checks = pa.concat_arrays([checks, pa.nulls(total[1], pa.int32())])
            keys = bands(own) if own else np.zeros((0, BANDS), np.uint64)
            keys = [pa.concat_arrays([pa.nulls(total[0], pa.int64()), _signed(keys[:, k])]) for k in range(BANDS)]
            yield pa.RecordBatch.from_arrays([ids, *places, _signed(names), checks, *keys], ["doc_id", "first", "last", "name", "check", *KEYS])

    kinds = ", ".join(f"{k} long" for k in KEYS)
    return staged(spark, docs.mapInArrow(rows, f"doc_id long, first int, last int, name long, check int, {kinds}"), "paragraphs")


def _copied(units: DataFrame) -> DataFrame:
    """Stretches that stand in several documents word by word, with the smallest of these."""
    units = units.filter("check is not null").select("doc_id", "first", "last", "name", "check")
    told = {"low": F.min("doc_id"), "high": F.max("doc_id")}
    return told_groups(units, ["name", "check"], told, "low <> high").select("doc_id", "first", "last", "low")


def _classes(spark: SparkSession, units: DataFrame) -> DataFrame:
    """The different lines: ``class, low, high`` (smallest and largest document) and their band keys."""
    found = units.filter("check is null").groupBy(F.col("name").alias("class"))
    found = found.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *[F.min(k).alias(k) for k in KEYS])
    return staged(spark, found, "line-classes")


def _banded(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """``key, class, leader`` for bands that hold different lines, of several documents; the leader is a band's smallest line.

    Copies of a line are one entry, and what is known of a crowded band comes from partial aggregates, so no task needs all of it.
    """
    entries = classes.select("class", "low", "high", F.explode(F.array(*KEYS)).alias("key"))
    told = {"leader": F.min("class"), "end": F.max("class"), "least": F.min("low"), "most": F.max("high")}
    return staged(spark, told_groups(entries, ["key"], told, "leader <> end and least <> most").select("key", "class", "leader"), "banded-lines")


def _bodies(spark: SparkSession, docs: DataFrame, classes: DataFrame, banded: DataFrame) -> DataFrame:
    """The whole shingle sets of all lines that share a band with a different line: ``class, body, n, bits``."""
    names = staged(spark, banded.select("class").distinct(), "banded-classes")
    holders = thinned(classes.select("class", F.col("low").alias("doc_id")), names)
    # No left semi join, which Spark would move to before the table of bits.
    holders = staged(spark, holders.join(small(spark, names, names), "class"), "line-holders")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, sets = [], []
            for text, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "wanted"))):
                held = line_shingles(text)[2]
                own = dict(zip(names_of(held).view(np.int64).tolist(), held)) if held else {}
                names += (found := own.keys() & set(wanted))
                sets += [np.unique(own[name]) for name in found]
            if sets:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(map(bitmap, sets), pa.binary()),
                    ],
                    ["class", "body", "n", "bits"],
                )

    # Only texts that hold a wanted line are shuffled, and of these only the wanted lines go on.
    wanted = holders.groupBy("doc_id").agg(F.collect_set("class").alias("wanted"))
    whole = thinned(docs, holders.select("doc_id")).join(small(spark, wanted, holders), "doc_id")
    whole = staged(spark, whole.select("text", "wanted").mapInArrow(bodies, "class long, body binary, n long, bits binary"), "line-bodies")
    # Rows that repeat a doc_id may repeat its lines; the sets are shuffled only then.
    if whole.groupBy("class").count().filter("count > 1").isEmpty():
        return whole
    return staged(spark, whole.dropDuplicates(["class"]), "line-bodies")


def _confirmed(spark: SparkSession, whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (columns ``a, b``), those that their whole shingle sets confirm."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(NEEDED[0] * common >= NEEDED[1] * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = staged(spark, pairs, "line-pairs")
    x, y = (whole.select(F.col("class").alias(c), F.col("body").alias(body)) for c, body in (("a", "x"), ("b", "y")))
    joined = pairs.join(thinned(x, pairs.select("a")), "a").join(thinned(y, pairs.select("b")), "b")
    return staged(spark, joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "line-links")


def _compared(allowed: int):
    """Pairs of lines of one band that are of different components and that sizes and bitmaps allow to be similar.

    Of a block with more of them than ``allowed`` for each member, the closest that join its components are named, and the closest
    of the others as far as allowed; ``withheld`` says that pairs are left.
    """

    def compared(table: pa.Table) -> pa.RecordBatch:
        name, size, comp, key, block = (table.column(c).to_numpy() for c in ("class", "n", "comp", "key", "block"))
        bits = Bitmaps(table.column("bits").to_pylist())
        found = [np.zeros((2, 0), np.int32)]
        for a, b in pairs_in_blocks(block, table.column("part").to_numpy()):
            apart = comp[a] != comp[b]
            a, b = a[apart], b[apart]
            fits = bits.may_link(size, a, b, NEEDED)
            found.append(np.array([a[fits], b[fits]], np.int32))
        left, right = np.concatenate(found, axis=1).astype(np.int64)
        order = np.argsort(block[left], kind="stable")
        left, right = left[order], right[order]
        rows, lists, held = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        edges = np.flatnonzero(np.diff(block[left])) + 1
        for a, b in zip(np.split(left, edges), np.split(right, edges)):
            most = allowed * int((block == block[a[0]]).sum()) if len(a) else 0
            if withheld := len(a) > most:
                near = np.argsort(bits.apart(a, b) / (size[a] + size[b]), kind="stable")
                a, b = a[near], b[near]
                some = np.union1d(spanning(a, b, comp), np.arange(most if allowed > 1 else 0))
                a, b = a[some], b[some]
            rows.append(np.c_[np.minimum(name[a], name[b]), np.maximum(name[a], name[b])])
            lists.append(key[a])
            held.append(np.full(len(a), withheld))
        both = np.concatenate(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(lists)), pa.array(np.concatenate(held))], ["a", "b", "key", "withheld"]
        )

    return whole_blocks(compared)


def _across(spark: SparkSession, banded: DataFrame, whole: DataFrame, links: DataFrame) -> DataFrame:
    """``links``, and confirmed ones between lines of one band that those leave in different components.

    A band with many pairs across components names those that join them, one for each member at most, and is read again with the
    components that these made; it names four times as many each time, until it has no other pair. So the pairs of a group of
    near copies grow with its size, and none is lost.
    """
    lists, allowed = banded.select("key", "class"), 1
    while True:
        named = lists.join(components(spark, links).withColumnRenamed("node", "class"), "class", "left")
        named = staged(spark, named.select("key", "class", F.coalesce("component", "class").alias("comp")), "named-bands")
        apart = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"))
        apart = apart.filter("low <> high").select("key", F.ceil(F.col("members") / PART).cast("int").alias("parts"))
        apart = staged(spark, apart, "bands-apart")
        lists = staged(spark, named.join(small(spark, apart, apart), "key"), "entries-apart")
        if lists.isEmpty():
            return links
        blocks = lists.join(whole.select("class", "n", "bits"), "class")
        blocks = in_parts(blocks, "key", "parts", "class", ["key", "class", "n", "comp", "bits"])
        found = staged(spark, blocks.mapInArrow(_compared(allowed), "a long, b long, key long, withheld boolean"), "pairs-across")
        links = links.unionByName(_confirmed(spark, whole, found.select("a", "b").distinct()))
        again = staged(spark, found.filter("withheld").select("key").distinct(), "bands-left")
        if again.isEmpty():
            return links
        lists, allowed = lists.select("key", "class").join(small(spark, again, again), "key", "left_semi"), 4 * allowed


def _alike(spark: SparkSession, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """``name, low`` of the lines whose component stands in several documents; a line that has no link is a component by itself."""
    linked = thinned(classes.select("class", "low", "high"), joined.select("class")).join(joined, "class")
    linked = staged(spark, linked, "linked-lines")
    over = linked.groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    over = staged(spark, over.filter("low <> high").select("component", "low"), "line-components")
    alike = linked.drop("low", "high").join(small(spark, over, over), "component").select("class", "low")
    alone = classes.filter("low <> high").select("class", "low").join(small(spark, joined.select("class"), joined), "class", "left_anti")
    return staged(spark, alike.unionByName(alone).withColumnRenamed("class", "name"), "alike-lines")


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's passages; the words of those kept elsewhere (``other``) are cut out of those kept here (``own``)."""
    for batch in sliced(batches):
        out = []
        for doc_id, own, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "own", "other"))):
            starts, ends = [], []
            for x in other:
                first, last = x["first_word"], x["last_word"]
                out.append((doc_id, first, last, x["low"]))
                if ends and first <= ends[-1]:
                    ends[-1] = max(ends[-1], last)
                else:
                    starts.append(first)
                    ends.append(last)
            for x in own:
                at, last = x["first_word"], x["last_word"]
                inside = range(bisect_right(ends, at), bisect_left(starts, last))
                for end, after in [*((starts[k], ends[k]) for k in inside), (last, last)]:
                    # What is left of a kept passage stays, whether it has a row or not.
                    if end - at >= STRETCH:
                        out.append((doc_id, at, end, doc_id))
                    at = after
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "first_word", "last_word", "keep_doc_id"])


def repeated_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per repeated passage of a document: ``doc_id, first_word, last_word, n_words, keep_doc_id, kept``.

    A passage is a run of words covered by paragraphs that also stand in another document: stretches word by word, lines of at
    least 26 words with a Jaccard similarity of 0.8 or more on shingles of five words. It covers words ``first_word`` up to, not
    including, ``last_word``. Similar lines form components; ``keep_doc_id`` is the smallest document that holds one of the
    paragraph's component, and only there it is ``kept``. Paragraphs that touch or overlap are one passage if they have the same
    ``keep_doc_id``. Words that a smaller document keeps are cut out of a kept passage, and what is left of it has a row if it is at
    least 26 words: without the passages that are not kept, each repeated stretch stays in one document. Passages that are not
    kept may overlap if different documents keep them.

    Documents without such a passage have no row, nor have null and empty texts, rows with a null doc_id, and passages that
    repeat only inside one document (rows with the same doc_id are one document). In a band each line is compared with one
    leader first, so that a group of copies costs one pair per line, and then with all lines that these links leave in another
    component. An empty table gives no rows, other columns are not read.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").filter("doc_id is not null and text is not null")
    units = _units(spark, docs)
    classes = _classes(spark, units)
    banded = _banded(spark, classes)
    whole = _bodies(spark, docs, classes, banded)
    stars = banded.filter("class <> leader").select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct()
    joined = components(spark, _across(spark, banded, whole, _confirmed(spark, whole, stars)))
    alike = _alike(spark, classes, joined.withColumnRenamed("node", "class"))
    repeated = units.filter("check is null").select("doc_id", "first", "last", "name").join(small(spark, alike, alike), "name")
    spans = _copied(units).unionByName(repeated.select("doc_id", "first", "last", "low"))
    order = Window.partitionBy("doc_id", "low").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.repartition("doc_id").withColumn("opens", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("passage", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "low", "passage").agg(F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"))
    own = F.when(F.col("doc_id") == F.col("low"), F.struct("first_word", "last_word"))
    other = F.when(F.col("doc_id") != F.col("low"), F.struct("first_word", "last_word", "low"))
    whole = merged.groupBy("doc_id").agg(F.collect_list(own).alias("own"), F.sort_array(F.collect_list(other)).alias("other"))
    passages = whole.mapInArrow(_passages, "doc_id long, first_word long, last_word long, keep_doc_id long")
    return passages.select(
        "doc_id", "first_word", "last_word", (F.col("last_word") - F.col("first_word")).alias("n_words"), "keep_doc_id",
        (F.col("doc_id") == F.col("keep_doc_id")).alias("kept"),
    )
