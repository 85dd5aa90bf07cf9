"""Near-duplicate vectors by p-stable hashing: quantised random projections in several tables, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm.blocks import in_parts, pairs_in_blocks, whole_blocks
from tableferry.llm.components import components, reachable
from tableferry.llm.shingles import mixed
from tableferry.llm.store import staged

COSINE = 0.93
# Two unit vectors of cosine 0.93 are 0.374 apart. A projection puts them into one cell of width 3 with probability 0.90, and
# unrelated ones with 0.63; so 20 projections agree with 0.12 against 0.0001, and 24 tables miss such a pair with 0.04, a
# pair of cosine 0.97 with 0.0006.
TABLES, PROJECTIONS, WIDTH = 24, 20, 3.0
SEED = 5
PART = 1024


def hash_keys(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> np.ndarray:
    """The key of each vector in each table: label, dimension, table and the cells of its projections."""
    dims = unit.shape[1]
    rng = np.random.default_rng([SEED, dims])
    axes, shift = rng.standard_normal((dims, tables * projections)), rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ axes + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    steps = np.random.default_rng(SEED + 1).integers(1, 1 << 63, projections, np.uint64) * np.uint64(2) + np.uint64(1)
    key = mixed((cells * steps).sum(axis=2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(key ^ mixed(labels.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(dims))[:, None]).view(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: a label, and a vector that is not null, not zero and without null or non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & some)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column("embedding").value_lengths().to_numpy()
        flat, ends = batch.column("embedding").flatten().to_numpy().astype(np.float64), np.r_[0, np.cumsum(lengths)]
        labels = batch.column("label").to_numpy()
        bodies, keys = [], np.zeros((len(labels), TABLES), np.int64)
        for dims in np.unique(lengths):
            of = np.flatnonzero(lengths == dims)
            rows = flat[ends[of][:, None] + np.arange(dims)]
            # The largest component is scaled out first, so that neither squares nor lengths overflow or vanish.
            rows = rows / np.abs(rows).max(axis=1, keepdims=True)
            keys[of] = hash_keys(rows / np.linalg.norm(rows, axis=1, keepdims=True), labels[of])
        for at, end in zip(ends, ends[1:]):
            bodies.append(flat[at:end].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("uid"),
                batch.column("label"),
                pa.array(bodies, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(labels) + 1, dtype=np.int32) * TABLES), pa.array(keys.ravel())),
            ],
            ["uid", "label", "body", "keys"],
        )


def _linked(cosine: float):
    """For each vector of some blocks: how many vectors it links to, and one of its component.

    A pair that several tables find counts in the first of them only.
    """

    def compared(table: pa.Table) -> pa.RecordBatch:
        uid, at, copies, block, part = (table.column(c).to_numpy() for c in ("uid", "at", "copies", "block", "part"))
        bodies = [np.frombuffer(x, np.float64) for x in table.column("body").to_pylist()]
        dims = np.array([len(x) for x in bodies])
        rows = np.zeros((len(bodies), dims.max()))
        for i, x in enumerate(bodies):
            rows[i, : len(x)] = x
        rows /= np.abs(rows).max(axis=1, keepdims=True)
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        links, lefts, rights = np.zeros(len(rows), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in pairs_in_blocks(block, part):
            near = np.einsum("ij,ij->i", rows[a], rows[b]) >= cosine
            near &= dims[a] == dims[b]
            a, b = a[near], b[near]
            before = np.arange(keys.shape[1]) < at[a][:, None]
            first = ~((keys[a] == keys[b]) & before).any(axis=1)
            np.add.at(links, a[first], copies[b[first]])
            np.add.at(links, b[first], copies[a[first]])
            lefts.append(a)
            rights.append(b)
        low = reachable(np.concatenate(lefts), np.concatenate(rights), len(rows))
        out = np.flatnonzero((links > 0) | (low != np.arange(len(low))))
        return pa.RecordBatch.from_arrays([pa.array(uid[out]), pa.array(links[out]), pa.array(uid[low[out]])], ["a", "links", "b"])

    return whole_blocks(compared)


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label link at a cosine of ``cosine`` or more in double precision. Identical vectors of a label are one entry
    with a count, so copies cost nothing. Each table buckets the entries; in each bucket all cosines are computed, block by
    block, long buckets in pairs of parts in different tasks. A bucket yields no pairs but a count and one link per vector.
    Pairs below the bound are never linked; of those at the bound itself the tables find 96 in 100, of closer ones more.

    Null labels, and vectors that are null, zero, empty or hold null or non-finite components, link with nothing; so do
    vectors of unlike dimension. Rows that repeat a vec_id are separate vectors. Null vec_ids stay null; a component's id
    is its smallest vec_id that is not null. An empty table gives no rows, and other columns are not read.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = staged(spark, rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    hashed = usable(rows).select("uid", "label", "embedding").mapInArrow(_hashed, "uid long, label long, body binary, keys array<long>")
    hashed = staged(spark, hashed, "vector-keys")
    classes = hashed.groupBy("label", "body").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies"))
    classes = staged(spark, classes.select("uid", "label", "copies", "body"), "different-vectors")
    entries = classes.select("uid", "copies").join(hashed.select("uid", "keys"), "uid")
    entries = staged(spark, entries.select("uid", "copies", F.posexplode("keys").alias("at", "key")), "buckets")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = staged(spark, sizes.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "shared-buckets")
    bodies = hashed.select("uid", "body", "keys")
    shared = staged(spark, entries.join(sizes, "key"), "shared-entries").join(bodies, "uid")
    blocks = in_parts(shared, "key", "parts", "uid", ["uid", "at", "copies", "body", "keys"])
    found = staged(spark, blocks.mapInArrow(_linked(cosine), "a long, links long, b long"), "vector-links")
    joined = components(spark, found.select("a", "b"))
    counts = staged(spark, found.groupBy("a").agg(F.sum("links").alias("links")), "link-counts")
    classes = (
        classes.select("uid", "label", "copies", "body")
        .join(counts.withColumnRenamed("a", "uid"), "uid", "left")
        .join(joined.withColumnRenamed("node", "uid"), "uid", "left")
        .select("label", "body", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    )
    classes = staged(spark, classes, "vector-classes")
    members = hashed.select("uid", "label", "body").join(classes, ["label", "body"]).select("uid", "n_links", "component")
    members = staged(spark, members.join(rows.select("uid", "vec_id"), "uid"), "vector-members")
    named = staged(spark, members.groupBy("component").agg(F.min("vec_id").alias("component_id")), "vector-components")
    out = members.join(named, "component").select("uid", "n_links", "component_id")
    own = F.coalesce("component_id", "vec_id")
    return rows.select("uid", "vec_id").join(staged(spark, out, "vector-results"), "uid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept")
    )
