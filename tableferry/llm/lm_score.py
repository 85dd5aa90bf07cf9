"""Scores of documents by cross-entropy difference between matched target and background bigram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm import tokens
from tableferry.llm.store import sliced, small, staged

IDS = 1 << 16
START = IDS - 1
# Weight of a pair's count against its second token's share, and what is added to each token's count.
MIX, ADDED = 16.0, 0.1
# A chunk of documents ends with the one that brings its tokens to this many; a document counts as EACH more.
CHUNK_TOKENS, EACH = 1 << 20, 16


@dataclass
class Unigrams:
    """Counts of the tokens of one text collection, and of the tokens before them."""

    single: np.ndarray
    first: np.ndarray
    vocabulary: int

    def loss(self, before: np.ndarray, ids: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Negative logarithm of each token's probability after the one before it; ``pair`` is how often both occur."""
        share = (self.single[ids] + ADDED) / (self.single.sum() + ADDED * self.vocabulary)
        return -np.log((pair + MIX * share) / (self.first[before] + MIX))


def _before(ids: np.ndarray) -> np.ndarray:
    return np.r_[np.uint16(START), ids[:-1]].astype(np.uint16)


def pairs_of(rows: list[np.ndarray]) -> np.ndarray:
    """Each token of each text and the one before it, as one number."""
    ids, before = np.concatenate(rows), np.concatenate([_before(r) if len(r) else r for r in rows])
    return (before.astype(np.uint32) << np.uint32(16)) | ids


def _signed(codes: np.ndarray) -> pa.Array:
    return pa.array(codes.view(np.int32))


def _encoded(spark: SparkSession, flagged: DataFrame, ranks: str, chunk_tokens: int) -> DataFrame:
    """The documents' ids by chunk and, beside them, the chunk's different pairs with their counts; written once.

    A chunk's rows have ``doc_id, target, ids``, its pairs ``pair, n, m``: how often the pair occurs in all texts and in the target's.
    """
    names = ["chunk", "doc_id", "target", "ids", "pair", "n", "m"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        waiting: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

        def counted() -> Iterator[pa.RecordBatch]:
            every = [r for own in waiting for r in own]
            if not sum(map(len, every)):
                return
            codes, n = np.unique(pairs_of(every), return_counts=True)
            m = np.zeros(len(codes), np.int64)
            if sum(map(len, waiting[1])):
                own, times = np.unique(pairs_of(waiting[1]), return_counts=True)
                m[np.searchsorted(codes, own)] = times
            for at in range(0, len(codes), 100_000):
                part = slice(at, at + 100_000)
                size = len(codes[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, chunk)), pa.nulls(size, pa.int64()), pa.nulls(size, pa.bool_()), pa.nulls(size, pa.binary()),
                     _signed(codes[part]), pa.array(n[part]), pa.array(m[part])], names
                )

        for batch in sliced(batches):
            chosen = batch.column("target").to_pylist()
            rows = [tokens.encode(t, ranks) for t in batch.column("text").to_pylist()]
            own = []
            for ids, target in zip(rows, chosen):
                own.append(chunk)
                waiting[target].append(ids)
                held += len(ids) + EACH
                if held >= chunk_tokens:
                    yield from counted()
                    waiting, chunk, held = ([], []), chunk + 1, 0
            size = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), batch.column("doc_id"), batch.column("target"), pa.array([r.tobytes() for r in rows], pa.binary()),
                 pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())], names
            )
        yield from counted()

    schema = "chunk long, doc_id long, target boolean, ids binary, pair int, n long, m long"
    return staged(spark, flagged.mapInArrow(encode, schema), "encoded")


def _unigrams(counts: DataFrame) -> tuple[Unigrams, Unigrams]:
    """The target's and the background's tokens, as sums over all pairs: 2 * 65,536 rows at most reach the driver."""
    flat = np.zeros((2, 2, IDS))
    for k, place in enumerate((F.col("pair").bitwiseAND(IDS - 1), F.shiftrightunsigned("pair", 16))):
        sums = counts.groupBy(place.alias("id")).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
        at = sums.column("id").to_numpy()
        flat[0, k, at], flat[1, k, at] = sums.column("n").to_numpy(), sums.column("m").to_numpy()
    vocabulary = max(1, int(np.count_nonzero(flat[0, 0])))
    background, target = (Unigrams(x[0], x[1], vocabulary) for x in flat)
    return target, background


def scores(
    spark: SparkSession, docs: DataFrame, targets: DataFrame, ranks_path: str | None = None, chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, target_loss, background_loss, score``.

    ``targets`` names the documents (doc_id) whose text is the target; the background is the text of all documents. Losses are
    means per token in nats, and the score is the target's less the background's: the lower, the more a text is like the
    target. Both models share the vocabulary of a public tokenizer, its order of two and smoothing.

    Every pair of tokens is counted by itself, and the counts are a table that is never gathered: chunks of documents name their
    different pairs, which are joined to it, and each chunk is scored where its counts come together. However frequent, a pair
    has one row per chunk.

    Null and empty texts have no tokens and score 0, as does everything if there is no target text. A null doc_id is never a
    target; rows that repeat a doc_id are scored each by its own text. Empty tables give no rows; other columns are not read.
    """
    ranks = ranks_path or tokens.default_ranks()
    named = staged(spark, targets.select("doc_id").filter("doc_id is not null").distinct(), "targets")
    named = small(spark, named.withColumn("target", F.lit(True)), named)
    flagged = docs.select("doc_id", "text").join(named, "doc_id", "left")
    flagged = flagged.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("target", F.lit(False)).alias("target"), "text")
    encoded = _encoded(spark, flagged, ranks, chunk_tokens)
    named_pairs = encoded.filter("pair is not null")
    counts = staged(spark, named_pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "pair-counts")
    both = spark.sparkContext.broadcast(_unigrams(counts))

    def losses(documents: pa.Table, known: pa.Table) -> pa.Table:
        target, background = both.value
        rows = [np.frombuffer(r, "<u2") for r in documents.column("ids").to_pylist()]
        sizes = np.array([len(r) for r in rows], np.int64)
        near, far = np.zeros(len(rows)), np.zeros(len(rows))
        if sizes.sum() and target.single.sum() > 0:
            codes = pairs_of(rows)
            pair = known.column("pair").to_numpy().view(np.uint32)
            order = np.argsort(pair)
            at = order[np.searchsorted(pair, codes, sorter=order)]
            ids, before = (codes & np.uint32(IDS - 1)).astype(np.int64), (codes >> np.uint32(16)).astype(np.int64)
            some = np.flatnonzero(sizes)
            starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
            near[some] = np.add.reduceat(target.loss(before, ids, known.column("m").to_numpy()[at]), starts) / sizes[some]
            far[some] = np.add.reduceat(background.loss(before, ids, known.column("n").to_numpy()[at]), starts) / sizes[some]
        return pa.table(
            [documents.column("doc_id"), pa.array(sizes), pa.array(near), pa.array(far), pa.array(near - far)],
            ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    known = named_pairs.select(F.col("chunk").alias("asked_by"), "pair").join(counts, "pair").select("asked_by", "pair", "n", "m")
    documents = encoded.filter("pair is null").select("chunk", "doc_id", "ids")
    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    return documents.groupBy("chunk").cogroup(known.groupBy("asked_by")).applyInArrow(losses, schema)
