"""Exact top-k by integer inner product: a kNN join over Voronoi groups, bounded by summaries and solved in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableferry.llm.store import staged

K, STEP, SCALE = 20, 20, 64.0
# Pivots: one for so many rows, and at most so many (the bounded sample), of which a prefix groups the queries.
CELL_ROWS, MOST_PIVOTS = 2048, 1024
# Rows of one block; a group of more rows is dealt over several.
DATA_BLOCK, QUERY_BLOCK = 2048, 4096
# Tasks of one query block: its data blocks go to at most so many, each of at least so many blocks.
MOST_SLICES, SLICE_BLOCKS = 64, 8
# Groups of data that each query block is solved with first; their scores are what all other groups must reach.
SEED_CELLS = 4
NONE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCK = "number long, slice long, uids binary, ids binary, body binary, dims long"


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole numbers per component, in 16 bits where all of a vector fit; vectors that do not stay finite are left out."""
    for batch in batches:
        lengths = batch.column("embedding").value_lengths().to_numpy()
        with np.errstate(over="ignore"):
            flat = np.floor(SCALE * batch.column("embedding").flatten().to_numpy().astype(np.float64))
        ends = np.r_[0, np.cumsum(lengths)]
        bodies = []
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            row = flat[a:b]
            high = np.abs(row).max(initial=0.0)
            bodies.append(None if not np.isfinite(high) else row.astype("<i2").tobytes() if high <= 32767 else row.astype("<f8").tobytes())
        body = pa.array(bodies, pa.binary())
        out = pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("vec_id"), pa.array(lengths.astype(np.int64)), body], ["uid", "vec_id", "dims", "body"])
        yield out.filter(body.is_valid())


def matrix_of(bodies: list[bytes], dims: int) -> np.ndarray:
    """Vectors of one length as whole numbers in double precision."""
    out = np.zeros((len(bodies), dims))
    for i, body in enumerate(bodies):
        out[i] = np.frombuffer(body, "<i2" if len(body) == 2 * dims else "<f8")
    return out


def inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products, exactly: in single or double precision where every sum is a whole number that it holds."""
    bound = left.shape[1] * np.abs(left).max(initial=0.0) * np.abs(right).max(initial=0.0)
    if bound < 1 << 24:
        return left.astype(np.float32) @ right.astype(np.float32).T
    if bound < 1 << 53:
        return left @ right.T
    a, b = ([[int(x) for x in row] for row in m] for m in (left, right))
    return np.array([[min(max(sum(x * y for x, y in zip(p, q)), NONE + 1), NO_ID) for q in b] for p in a], np.int64).reshape(len(a), len(b))


@dataclass(frozen=True)
class Groups:
    """The Voronoi groups of one vector length: pivots, and of each group its largest distance, largest norm and blocks."""

    pivots: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What no score of a query (row) with a member of a group (column) exceeds; empty groups have minus infinity."""
        length = np.linalg.norm(queries, axis=1)[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.minimum(queries @ self.pivots.T + length * self.radius, length * self.norm)
            most += np.abs(most) * 1e-9 + 1
        most[np.isnan(most)] = np.inf
        return np.where(self.blocks > 0, most, -np.inf)


def _nearest(pivots: dict[int, np.ndarray], rows: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pivot of each row, the one among the first ``few``, and the distance to the former."""
    known = pivots.get(rows.shape[1], np.zeros((1, rows.shape[1])))
    with np.errstate(over="ignore", invalid="ignore"):
        apart = (known**2).sum(axis=1) - 2 * rows @ known.T
        cell, group = apart.argmin(axis=1), apart[:, :few].argmin(axis=1)
        return cell, group, np.linalg.norm(rows - known[cell], axis=1)


def top_rows(best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Bring the better of ``scores`` (one row per query) into ``best``, the k scores and ids so far, ties to smaller ids."""
    held, names = best
    for low in range(0, len(scores), 512):
        some, part = slice(low, low + 512), scores[low : low + 512]
        least = held[some, -1].astype(part.dtype) if part.dtype == np.int64 else np.where(held[some, -1] == NONE, -np.inf, held[some, -1]).astype(part.dtype)
        reach = part >= least[:, None]
        if reach.sum() > 4 * k * len(part) and part.shape[1] > k:
            reach &= part >= np.partition(part, part.shape[1] - k, axis=1)[:, [part.shape[1] - k]]
        reach &= part != (NONE if part.dtype == np.int64 else -np.inf)
        row, at = np.nonzero(reach)
        if not len(row):
            continue
        size = len(part)
        rows = np.r_[np.repeat(np.arange(size), k), row]
        score = np.r_[held[some].ravel(), part[row, at].astype(np.int64)]
        name = np.r_[names[some].ravel(), ids[at]]
        order = np.lexsort((name, -(score + 1), rows))
        start = np.searchsorted(rows[order], np.arange(size))
        chosen = order[(start[:, None] + np.arange(k)).ravel()]
        held[some], names[some] = score[chosen].reshape(size, k), name[chosen].reshape(size, k)


def _solved(k: int):
    """Walk each query block with its data blocks, which follow it, and keep only the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids = queries = best = where = None

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([where[0]]), *[pa.array([x.tobytes()], pa.binary()) for x in (uids, *best)]], ["number", "uids", "scores", "ids"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("query_block", "part", "uids", "ids", "body", "dims", "is_query")}
                own, ids = np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                rows = np.frombuffer(row["body"], "<f8" if len(row["body"]) == 8 * row["dims"] * len(own) else "<i2").reshape(len(own), -1).astype(np.float64)
                if row["is_query"]:
                    if where is not None:
                        yield given()
                    where, uids, queries = (row["query_block"], row["part"]), own, rows
                    best = np.full((len(own), k), NONE), np.full((len(own), k), NO_ID)
                    continue
                scores = inner(queries, rows)
                at = np.minimum(np.searchsorted(own, uids), len(own) - 1)
                same = np.flatnonzero(own[at] == uids)
                scores[same, at[same]] = NONE if scores.dtype == np.int64 else -np.inf
                top_rows(best, scores, ids, k)
        if where is not None:
            yield given()

    return run


def _blocks(rows: DataFrame, group: str, parts: DataFrame) -> DataFrame:
    """The rows of each group as matrices of bounded size, dealt by a hash of the row."""

    def built(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        dims = table.column("dims")[0].as_py()
        matrix = matrix_of(table.column("body").to_pylist(), dims)
        kind = "<i2" if np.abs(matrix).max(initial=0.0) <= 32767 else "<f8"
        ids = table.column("vec_id").fill_null(int(NO_ID)).to_numpy()
        values = [key[0].as_py(), table.column("slice")[0].as_py(), table.column("uid").to_numpy().tobytes(), ids.tobytes(), matrix.astype(kind).tobytes(), dims]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], [c.split()[0] for c in BLOCK.split(", ")])

    dealt = rows.join(F.broadcast(parts), ["dims", group])
    dealt = dealt.withColumn("number", F.col("first") + F.pmod(F.xxhash64("uid"), F.col("blocks")))
    slices = F.floor(F.col("number") * F.col("slices") / F.col("all_blocks")).cast("long")
    return dealt.select("number", slices.alias("slice"), "uid", "vec_id", "dims", "body").groupBy("number").applyInArrow(built, BLOCK)


def _numbered(rows: DataFrame, group: str, size: int) -> list[tuple]:
    """Blocks of each group: ``dims, group, radius, norm, first block, blocks``; one row per pivot reaches the driver."""
    found = rows.groupBy("dims", group).agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"), F.max("norm").alias("norm"))
    out, first = [], 0
    for r in sorted(found.collect(), key=lambda r: (r["dims"], r[group])):
        blocks = -(-r["n"] // size)
        out.append((r["dims"], r[group], r["radius"], r["norm"], first, blocks))
        first += blocks
    return out


def nearest_neighbours(
    spark: SparkSession, vectors: DataFrame, k: int = K, step: int = STEP, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The ``k`` highest inner products of each query with all other rows: ``query_id, rank, vec_id, score``.

    Components x become floor(64 * x). Queries are the rows whose vec_id ``step`` divides; candidates are all rows but the
    query's own. Rows belong to the nearest of a bounded sample of pivots; each group is summed up by its largest distance from
    the pivot and largest norm, which bound all its scores with a query. Queries are grouped likewise, solved with the few
    groups that most of them are nearest to, and then with every group whose bound reaches the k-th score found: only to these
    is the query block sent. Blocks are matrices of bounded size, so a group with very many rows is many blocks, and
    a task holds one query block, one data block and k results per query. Pivots decide how much is compared, never the result.

    Vectors that are null, or hold null or non-finite components (also after the multiplication), take no part; only vectors
    of one length are compared. Ties go to smaller vec_ids; rows without a vec_id come last among ties, as null, and are no queries.
    Rows that repeat a vec_id are separate. Scores beyond 64 bits are cut to them. No rows give no rows; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.filter(F.col("embedding").isNotNull() & ~bad).select("uid", "vec_id", "embedding")
    whole = staged(spark, whole.mapInArrow(_quantised, "uid long, vec_id long, dims long, body binary"), "whole-vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    count = whole.count()
    if not count:
        return empty

    sample = whole.orderBy(F.xxhash64("uid"), "uid").limit(min(MOST_PIVOTS, -(-count // cell_rows))).select("dims", "body").collect()
    pivots = {d: matrix_of([bytes(r["body"]) for r in sample if r["dims"] == d], d) for d in {r["dims"] for r in sample}}
    few = max(1, min(MOST_PIVOTS, -(-count // (step * query_block))))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bodies = batch.column("dims").to_numpy(), batch.column("body").to_pylist()
            cell, group, apart, norm = (np.zeros(len(dims), t) for t in (np.int64, np.int64, float, float))
            for d in np.unique(dims):
                of = np.flatnonzero(dims == d)
                matrix = matrix_of([bodies[i] for i in of], int(d))
                cell[of], group[of], apart[of] = _nearest(shared.value, matrix, few)
                norm[of] = np.linalg.norm(matrix, axis=1)
            names = [*batch.schema.names, "cell", "query_cell", "apart", "norm"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (cell, group, apart, norm))], names)

    placed = whole.mapInArrow(assign, "uid long, vec_id long, dims long, body binary, cell long, query_cell long, apart double, norm double")
    placed = staged(spark, placed, "placed-vectors")
    asked = placed.filter(F.col("vec_id") % step == 0)
    cells, query_cells = _numbered(placed, "cell", data_block), _numbered(asked, "query_cell", query_block)
    if not query_cells:
        return empty
    block_count = cells[-1][4] + cells[-1][5]
    slices = min(MOST_SLICES, -(-block_count // SLICE_BLOCKS))

    def parts(found: list[tuple], group: str, slices: int) -> DataFrame:
        total = found[-1][4] + found[-1][5]
        return spark.createDataFrame([(r[0], r[1], r[4], r[5], slices, total) for r in found], f"dims long, {group} long, first long, blocks long, slices long, all_blocks long")

    data = staged(spark, _blocks(placed, "cell", parts(cells, "cell", slices)), "data-blocks")
    queries = staged(spark, _blocks(asked, "query_cell", parts(query_cells, "query_cell", 1)), "query-blocks")
    groups = {}
    for d in {r[0] for r in cells}:
        known = pivots.get(d, np.zeros((1, d)))
        table = np.zeros((4, len(known)))
        for _, cell, radius, norm, first, blocks in (r for r in cells if r[0] == d):
            table[:, cell] = radius, norm, first, blocks
        groups[d] = Groups(known, table[0], table[1], table[2].astype(np.int64), table[3].astype(np.int64))
    summaries = spark.sparkContext.broadcast(groups)

    def seeds(found: Groups, rows: np.ndarray) -> np.ndarray:
        nearest = ((found.pivots**2).sum(axis=1) - 2 * rows @ found.pivots.T + np.where(found.blocks > 0, 0, np.inf)).argmin(axis=1)
        common = np.bincount(nearest, minlength=len(found.pivots))
        return np.argsort(-common, kind="stable")[:SEED_CELLS][np.sort(common)[::-1][:SEED_CELLS] > 0]

    def pairs(first_round: bool):
        """The data blocks that each query block needs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    found, size = summaries.value[row["dims"]], len(row["uids"]) // 8
                    rows = np.frombuffer(row["body"], "<f8" if len(row["body"]) == 8 * row["dims"] * size else "<i2").reshape(size, -1).astype(np.float64)
                    own = seeds(found, rows)
                    if first_round:
                        needed = own
                    else:
                        least = np.frombuffer(row["scores"], "<i8").reshape(size, k)[:, -1].astype(float)
                        reach = ~(found.bounds(rows) < least[:, None]).all(axis=0) & (found.blocks > 0)
                        needed = np.setdiff1d(np.flatnonzero(reach), own)
                    numbers = [np.arange(found.first[j], found.first[j] + found.blocks[j]) for j in needed]
                    numbers = np.concatenate([np.zeros(0, np.int64), *numbers])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), row["number"])), pa.array(numbers)], ["query_block", "number"])

        return run

    def solved(wanted: DataFrame, one_task: bool) -> DataFrame:
        wanted = staged(spark, wanted, "block-pairs")
        part = F.lit(0).cast("long") if one_task else F.col("slice")
        payload = ["uids", "ids", "body", "dims"]
        sent = wanted.join(data, "number").select("query_block", part.alias("part"), *payload, F.lit(False).alias("is_query"))
        places = wanted.join(data.select("number", "slice"), "number").select("query_block", part.alias("part")).distinct()
        own = places.join(queries.withColumnRenamed("number", "query_block"), "query_block").select("query_block", "part", *payload, F.lit(True).alias("is_query"))
        met = own.unionByName(sent).repartition("query_block", "part").sortWithinPartitions("query_block", "part", F.desc("is_query"))
        return staged(spark, met.mapInArrow(_solved(k), "number long, uids binary, scores binary, ids binary"), "solved")

    first = solved(queries.select("number", "uids", "body", "dims").mapInArrow(pairs(True), "query_block long, number long"), True)
    known = queries.select("number", "uids", "body", "dims").join(first.select("number", "scores"), "number")
    rest = solved(known.mapInArrow(pairs(False), "query_block long, number long"), False)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, scores, ids in zip(*(batch.column(c).to_pylist() for c in ("uids", "scores", "ids"))):
                uids, scores, ids = (np.frombuffer(x, "<i8") for x in (uids, scores, ids))
                there = scores != NONE
                yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (np.repeat(uids, k), ids, scores)], ["uid", "vec_id", "score"])

    found = first.unionByName(rest).mapInArrow(unpacked, "uid long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = asked.select("uid", F.col("vec_id").alias("query_id"))
    return best.join(names, "uid").select("query_id", "rank", F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), "score")


ORACLE = """
with whole as (
  select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, x.vec_id, cast(list_inner_product(q.v, x.v) as bigint) as score
  from whole q join whole x on q.vec_id % 20 = 0 and x.vec_id <> q.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
"""
