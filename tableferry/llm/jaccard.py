"""Self-join of shingle sets by Jaccard similarity: subsets of small sets, inverted lists of large ones."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableferry.llm.blocks import in_parts, pairs_in_blocks, whole_blocks
from tableferry.llm.components import components, reachable
from tableferry.llm.shingles import mixed, shingle_set
from tableferry.llm.store import sliced, small, staged

# Sets link when NEEDED[0] * intersection >= NEEDED[1] * union.
NEEDED = (100, 80)
# Small sets are looked up by subsets of this many shingles.
SUBSET = 2
# The most frequent shingles known by rank; the order only decides how long lists get, never what is found.
RANKED = 1 << 18
# Shingles counted at a time inside a task.
TALLY = 4_000_000
BITS, MOST_BITS = 512, 1 << 17
# Of its keys each set carries so many, the smallest, by which a pair that meets in several lists is told in the first of them.
LEADING = 6
# Members of a list that are compared with each other in one task; longer lists are cut into pairs of such parts.
PART = 2048


def least_common(size: int, needed: tuple[int, int] = NEEDED) -> int:
    """A set of this size shares at least so many shingles with any set it links to."""
    return -(-needed[1] * size // needed[0])


def prefix_length(size: int, needed: tuple[int, int] = NEEDED, shared: int = 1) -> int:
    """Of linked sets in one common order, the first so many shingles of each have ``shared`` in common."""
    return size - least_common(size, needed) + shared


def boundary(mean_list: float, needed: tuple[int, int] = NEEDED) -> int:
    """The largest size for which all subsets of the prefix cost less than the lists of its shingles.

    A set of prefix length p costs C(p + 1, 2) subset keys, or p keys that each meet ``mean_list`` entries.
    """
    size = 4
    while True:
        p = prefix_length(size + 1, needed)
        if p * (p + 1) / 2 > p * (1 + mean_list):
            return size
        size += 1


def set_keys(ordered: np.ndarray, light: int, needed: tuple[int, int] = NEEDED) -> np.ndarray:
    """The keys under which a set, rarest shingle first, is listed.

    A small set has the subsets of its prefix; it is listed by single shingles, too, if a large set could link to it. Sets
    of fewer than ``SUBSET`` shingles, and all that can link only to equal sets, have no key.
    """
    size = len(ordered)
    if least_common(size, needed) < SUBSET or not _may_differ(size, needed):
        return ordered[:0]
    single = ordered[: prefix_length(size, needed)]
    if size > light:
        return single
    wide = ordered[: prefix_length(size, needed, SUBSET)]
    left, right = np.array(list(combinations(range(len(wide)), SUBSET))).reshape(-1, SUBSET).T
    low, high = np.minimum(wide[left], wide[right]), np.maximum(wide[left], wide[right])
    subsets = mixed(low * np.uint64(3) + mixed(high))
    return np.r_[subsets, single] if needed[0] * size > needed[1] * light else subsets


def _may_differ(size: int, needed: tuple[int, int]) -> bool:
    """Whether a set with one shingle more can link to one of this size, or one of this size to one with one less."""
    return needed[0] * size >= needed[1] * (size + 1) or needed[0] * (size - 1) >= needed[1] * size


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _frequent(spark: SparkSession, docs: DataFrame) -> tuple[np.ndarray, float]:
    """The most frequent shingles, most frequent last, and the mean length of the lists of all others.

    Every task counts all its shingles and reports those that repeat among its own rows; these sums are added over all
    tasks. ``RANKED`` numbers reach the driver.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(waiting), return_counts=True)
            often = times >= 3
            total = np.array([held], np.int64)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([_signed(found[often]), pa.nulls(1, pa.int64())]),
                    pa.concat_arrays([pa.array(times[often].astype(np.int64)), pa.array(total)]),
                ],
                ["token", "n"],
            )
            waiting.clear()
            return out

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                waiting.append(shingle_set(text))
                held += len(waiting[-1])
                if held >= TALLY:
                    yield counted()
                    held = 0
        if waiting:
            yield counted()

    sums = staged(spark, docs.select("text").mapInArrow(tally, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "shingle-counts")
    total = sums.filter("token is null").agg(F.max("n")).first()[0] or 0
    reported = sums.filter("token is not null")
    top = reported.orderBy(F.desc("n"), "token").limit(RANKED).toArrow()
    counts = top.column("n").to_numpy().astype(float)
    squares, once = reported.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum("n")).first()
    rest = total - float(once or 0)
    mean = 1.0 + max(0.0, float(squares or 0) - float((counts**2).sum())) / max(1.0, rest)
    return top.column("token").to_numpy().astype(np.int64).view(np.uint64)[::-1], mean


def in_order(found: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Shingles by one order for all sets: those not ranked by hash, then the ranked ones from rare to frequent."""
    if not len(known):
        return found
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    hot = known[at] == found
    if not hot.any():
        return found
    return np.r_[found[~hot], found[hot][np.argsort(rank[at[hot]], kind="stable")]]


def bitmap(found: np.ndarray) -> bytes:
    """The parity of how many shingles fall on each place: two bitmaps differ in no more places than their sets differ.

    There are about as many places as shingles, so that unlike sets of any size show; a bitmap is halved by joining its halves.
    """
    places = BITS
    while places < min(len(found), MOST_BITS):
        places *= 2
    hits = np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(hits.astype(np.uint8)).tobytes()


def _halved(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_link(size_a, size_b, apart, needed: tuple[int, int]):
    """100 (s - d) / 2 >= 80 (s + d) / 2 for the sum s of the sizes and at least d shingles that only one set has."""
    return (needed[0] - needed[1]) * (size_a + size_b) >= (needed[0] + needed[1]) * apart


class Bitmaps:
    """The bitmaps of some sets, each pair compared at the size of the smaller one."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = [np.frombuffer(r, np.uint8) for r in rows]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.tables: dict[int, np.ndarray] = {}

    def _table(self, size: int) -> np.ndarray:
        """All bitmaps of at least this size, halved to it; rows of smaller ones are empty."""
        if size not in self.tables:
            table = np.zeros((len(self.rows), size), np.uint8)
            for i in np.flatnonzero(self.sizes >= size):
                table[i] = _halved(self.rows[i], size)
            self.tables[size] = table.view(np.uint64)
        return self.tables[size]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many places the bitmaps differ: no more than the sets do."""
        smaller, apart = np.minimum(self.sizes[a], self.sizes[b]), np.zeros(len(a), np.int64)
        for width in np.unique(smaller):
            every = np.flatnonzero(smaller == width)
            table = self._table(int(width))
            for at in range(0, len(every), 1 << 16):
                of = every[at : at + (1 << 16)]
                apart[of] = np.bitwise_count(table[a[of]] ^ table[b[of]]).sum(axis=1, dtype=np.int64)
        return apart

    def may_link(self, size: np.ndarray, a: np.ndarray, b: np.ndarray, needed: tuple[int, int]) -> np.ndarray:
        return may_link(size[a], size[b], self.apart(a, b), needed)


def set_name(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _sets(spark: SparkSession, docs: DataFrame, needed: tuple[int, int]) -> DataFrame:
    """Every document's set: ``doc_id, set_id, n, keys, bits``, written once; a set's copies in one task share one row's keys and bits."""
    frequent, mean = _frequent(spark, docs)
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], order, boundary(mean, needed)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, light = shared.value
        seen: set[int] = set()
        for batch in sliced(batches):
            names, sizes, keys, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text)
                names.append(name := set_name(found))
                sizes.append(len(found))
                again = name in seen
                seen.add(name)
                keys.append(found[:0].view(np.int64) if again else set_keys(in_order(found, known, rank), light, needed).view(np.int64))
                bits.append(None if again else bitmap(found))
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bits, pa.binary())],
                ["doc_id", "set_id", "n", "keys", "bits"],
            )

    pairs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    return staged(spark, pairs.mapInArrow(rows, "doc_id long, set_id long, n long, keys array<long>, bits binary"), "sets")


def _sizes_allow(a: str, b: str, needed: tuple[int, int]):
    return F.least(a, b) * needed[0] >= F.greatest(a, b) * needed[1]


def verified(spark: SparkSession, docs: DataFrame, sets: DataFrame, pairs: DataFrame, needed: tuple[int, int] = NEEDED) -> DataFrame:
    """Of ``pairs`` (columns ``a, b``), those whose whole sets are similar enough; bitmaps decide which sets are fetched."""
    pairs = staged(spark, pairs, "pairs")
    names = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    held = sets.filter("doc_id is not null").join(small(spark, names, pairs), "set_id", "left_semi").groupBy("set_id")
    held = staged(spark, held.agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bits").alias("bits")), "pair-bitmaps")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            count = batch.num_rows
            bits = Bitmaps(batch.column("x").to_pylist() + batch.column("y").to_pylist())
            size = np.r_[batch.column("m").to_numpy(), batch.column("n").to_numpy()]
            ok = bits.may_link(size, np.arange(count), np.arange(count) + count, needed)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    both = pairs.join(held.select(F.col("set_id").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x")), "a").join(
        held.select(F.col("set_id").alias("b"), "n", F.col("bits").alias("y")), "b"
    )
    pairs = staged(spark, both.select("a", "b", "m", "n", "x", "y").mapInArrow(filtered, "a long, b long"), "likely-pairs")
    names = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = staged(spark, held.select("set_id", "doc_id").join(names, "set_id", "left_semi"), "wanted")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(set_name, found), pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["set_id", "body"]
            )

    whole = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").join(small(spark, wanted.select("doc_id"), wanted), "doc_id", "left_semi")
    # Rows that repeat a doc_id with another text have another name, and the same text has the same body.
    whole = staged(spark, whole.select("text").mapInArrow(bodies, "set_id long, body binary").dropDuplicates(["set_id"]), "bodies")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(needed[0] * common >= needed[1] * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(whole.select(F.col("set_id").alias("a"), F.col("body").alias("x")), "a").join(
        whole.select(F.col("set_id").alias("b"), F.col("body").alias("y")), "b"
    )
    return staged(spark, joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")


def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs, best first, join the labels of their rows: a forest, found by every label's best pair in each round."""
    at, chosen = np.arange(len(a)), [np.zeros(0, np.int64)]
    label = np.unique(label, return_inverse=True)[1]
    while len(at := at[label[a[at]] != label[b[at]]]):
        x, y = label[a[at]], label[b[at]]
        best = np.full(label.max() + 1, len(at))
        np.minimum.at(best, x, np.arange(len(at)))
        np.minimum.at(best, y, np.arange(len(at)))
        pick = np.unique(best[best < len(at)])
        chosen.append(at[pick])
        label = reachable(x[pick], y[pick], len(best))[label]
    return np.concatenate(chosen)


def _candidates(needed: tuple[int, int], allowed: int):
    """Pairs inside lists that are of different components and that sizes and bitmaps allow.

    Of a block with more pairs than ``allowed`` for each member, the closest that join its components are named, and the
    closest of the others as far as allowed; ``withheld`` says that pairs are left. After the first round pairs are left
    only where many do not hold, as those that hold have made one component of their sets.
    """

    def compared(table: pa.Table) -> pa.RecordBatch:
        name, size, comp = (table.column(c).to_numpy() for c in ("set_id", "n", "comp"))
        bits = Bitmaps(table.column("bits").to_pylist())
        key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        leading = table.column("leading").combine_chunks()
        own = np.repeat(np.arange(len(name)), leading.value_lengths().to_numpy())
        keys = np.zeros((len(name), LEADING), np.int64)
        known = np.zeros((len(name), LEADING), bool)
        at = np.arange(len(own)) - np.repeat(np.flatnonzero(np.diff(own, prepend=-1)), np.unique(own, return_counts=True)[1])
        keys[own, at], known[own, at] = leading.flatten().to_numpy(), True
        found = [np.zeros((2, 0), np.int32)]
        for a, b in pairs_in_blocks(block, table.column("part").to_numpy()):
            ok = comp[a] != comp[b]
            ok &= np.minimum(size[a], size[b]) * needed[0] >= np.maximum(size[a], size[b]) * needed[1]
            a, b = a[ok], b[ok]
            fits = bits.may_link(size, a, b, needed)
            a, b = a[fits], b[fits]
            shared = (keys[a][:, :, None] == keys[b][:, None, :]) & known[a][:, :, None] & known[b][:, None, :]
            least = np.where(shared.any(axis=2), keys[a], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
            # A pair that shares a leading key is named in the list of the least of those; one that shares none, in all its lists.
            once = (least == key[a]) | (least == np.iinfo(np.int64).max)
            found.append(np.array([a[once], b[once]], np.int32))
        left, right = np.concatenate(found, axis=1).astype(np.int64)
        by_block = np.argsort(block[left], kind="stable")
        bounds = np.flatnonzero(np.diff(block[left[by_block]], prepend=np.iinfo(np.int64).min))
        rows, lists, held = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for low, high in zip(bounds, [*bounds[1:], len(left)]):
            a, b = left[by_block[low:high]], right[by_block[low:high]]
            most = allowed * int((block == block[a[0]]).sum())
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


def similar_sets(spark: SparkSession, docs: DataFrame, needed: tuple[int, int] = NEEDED) -> tuple[DataFrame, DataFrame]:
    """The documents' sets, and links that join every component of similar sets (not every link inside one).

    1. Each different set is listed under its keys. A list of one set is dropped.
    2. In each list every set is paired with the one of the smallest name of about its size, which is the same in most lists
       of a group. What the whole sets confirm gives components, so that a large group of near copies is joined by a few links each.
    3. In lists that still hold several components, pairs across components that sizes and bitmaps allow are checked against
       the whole sets. Both filters only drop pairs that cannot link. A list with many such pairs names the closest that join its
       components, at most one for each member, and is looked at again with the components that these made: it names four
       times as many each time, until it has no other pair across components. So no two similar sets stay apart.

    Lists longer than ``PART`` are compared part by part in different tasks. All joins are on ids; whole sets travel only
    for pairs that are left.
    """
    sets = _sets(spark, docs, needed)
    entries = sets.select("set_id", "n", F.explode("keys").alias("key"))
    whole = Window.partitionBy("key")
    by_size = whole.orderBy("n", "set_id")
    own = F.struct("n", "set_id")
    listed = (
        entries.withColumn("first", F.min(own).over(whole))
        .withColumn("end", F.max(own).over(whole))
        .withColumn("back", F.lag(own).over(by_size))
        .withColumn("next", F.lead(own).over(by_size))
    )
    # Copies of a set follow each other, and one entry of them is enough. An entry stays if a neighbour by size is near enough
    # to link; if the one after it is a copy, what follows that is not known here, and it stays.
    again = F.coalesce(F.col("back.set_id") == F.col("set_id"), F.lit(False))
    near = [F.coalesce(_sizes_allow("n", other, needed), F.lit(False)) for other in ("back.n", "next.n")]
    lists = listed.filter((F.col("first.set_id") != F.col("end.set_id")) & ~again & (near[0] | near[1]))
    lists = staged(spark, lists.select("key", "set_id", "n"), "lists")

    # Sizes within one class are near enough to link. A second division, half a class off, joins groups that a border cuts.
    size = F.log(needed[0] / needed[1], F.col("n").cast("double"))
    classes = [Window.partitionBy("key", F.floor(size + shift)) for shift in (0.0, 0.5)]
    firsts = F.array(*[F.min("set_id").over(own) for own in classes])
    stars = lists.select(F.col("set_id").alias("a"), firsts.alias("firsts"))
    stars = stars.select("a", F.explode(F.array_distinct("firsts")).alias("b")).filter("a <> b").distinct()
    links = verified(spark, docs, sets, stars, needed)
    joined = components(spark, links)

    # Sets that can link are of one class of size or of neighbouring ones; a set stays if those hold another component.
    about = Window.partitionBy("key").orderBy("class").rangeBetween(-1, 1)
    comp, allowed = F.coalesce("component", "set_id").alias("comp"), 1
    while True:
        named = lists.select("key", "set_id", "n").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left")
        named = named.select("key", "set_id", "n", comp, F.floor(size).cast("int").alias("class"))
        parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("key")) / PART).cast("int")
        apart = named.withColumn("low", F.min("comp").over(about)).withColumn("high", F.max("comp").over(about)).withColumn("parts", parts)
        lists = staged(spark, apart.filter("low <> high").select("key", "set_id", "n", "comp", "parts"), "mixed-lists")
        if lists.isEmpty():
            return sets, links
        if allowed == 1:
            bits = sets.filter("bits is not null").select("set_id", "bits").join(lists.select("set_id").distinct(), "set_id", "left_semi")
            leading = lists.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEADING).alias("leading"))
            bits = staged(spark, bits.dropDuplicates(["set_id"]).join(leading, "set_id"), "bitmaps")
        blocks = in_parts(lists.join(bits, "set_id"), "key", "parts", "set_id", ["key", "set_id", "n", "comp", "bits", "leading"])
        found = staged(spark, blocks.mapInArrow(_candidates(needed, allowed), "a long, b long, key long, withheld boolean"), "candidates")
        links = links.unionByName(verified(spark, docs, sets, found.select("a", "b").distinct(), needed))
        again = staged(spark, found.filter("withheld").select("key").distinct(), "lists-left")
        if again.isEmpty():
            return sets, links
        joined, allowed = components(spark, links), 4 * allowed
        lists = lists.select("key", "set_id", "n").join(small(spark, again, again), "key", "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, needed: tuple[int, int] = NEEDED) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Documents are linked when ``needed[0]`` times the intersection of their sets is at least ``needed[1]`` times the union;
    equal sets are one class. Null and empty texts have an empty set and stand alone. Rows with a null doc_id are
    returned with a null component_id and link nothing; rows that repeat a doc_id are compared each by its own text.
    Every word of a text of any length counts. An empty table gives no rows, and other columns are not read.
    """
    sets, links = similar_sets(spark, docs, needed)
    joined = components(spark, links)
    smallest = sets.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    named = staged(spark, smallest.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left"), "classes")
    over = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(staged(spark, over, "component-ids"), "component", "left")
    named = staged(spark, named.select("set_id", F.coalesce("component_id", "doc_id").alias("component_id")), "class-ids")
    rows = sets.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id"),
    )


def keep_one(spark: SparkSession, docs: DataFrame, needed: tuple[int, int] = NEEDED) -> DataFrame:
    """The documents, with all their columns, without those that are linked to one with a smaller doc_id."""
    found = near_duplicates(spark, docs, needed).filter("doc_id is not null")
    gone = found.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high"))
    gone = staged(spark, gone.filter("high < doc_id").select("doc_id"), "near-duplicates")
    return docs.join(small(spark, gone, gone), "doc_id", "left_anti").select(*docs.columns)
