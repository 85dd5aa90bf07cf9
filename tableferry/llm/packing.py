"""Packing of documents into training sequences by lexical retrieval: sharded BM25, unused neighbours, greedy filling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm import tokens
from tableferry.llm.store import sliced, staged

WINDOW = 1024
IDS = 1 << 16
# A shard ends with the document that brings the tokens still to be packed to this many.
SHARD_TOKENS = 1 << 20
# Neighbours are ranked so many at a time: a window seldom needs more.
NEIGHBOURS = 64
K1, B = 1.2, 0.75


@dataclass
class Corpus:
    """Counts over all documents, shared by every shard."""

    idf: np.ndarray
    mean_length: float


def tokenised(spark: SparkSession, docs: DataFrame, ranks_path: str) -> tuple[DataFrame, Corpus]:
    """Every document's ids, written once, and counts over all of them.

    The ids are 16-bit numbers, about as large as the compressed text. Beside the documents each task writes its sums, so that
    no second pass over the ids is needed; at most 65,536 totals reach the driver.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, totals, present = np.zeros(IDS, np.int64), np.zeros(2, np.int64), np.zeros(IDS, bool)

        def rows(doc_ids, ids: list, terms: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            gap = len(terms) or len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    doc_ids if len(ids) else pa.nulls(gap, pa.int64()),
                    pa.array(ids or [None] * gap, pa.binary()),
                    pa.array(terms, pa.int32()) if len(terms) else pa.nulls(gap, pa.int32()),
                    pa.array(sums, pa.int64()) if len(terms) else pa.nulls(gap, pa.int64()),
                ],
                ["doc_id", "ids", "term", "n"],
            )

        for batch in sliced(batches):
            out = []
            for text in batch.column(1).to_pylist():
                ids = tokens.encode(text, ranks_path, end=True)
                present[ids] = True
                found = np.flatnonzero(present)
                seen[found] += 1
                present[found] = False
                totals += 1, len(ids)
                out.append(ids.tobytes())
            if out:
                yield rows(batch.column(0), out, [], [])
        found = np.flatnonzero(seen)
        if len(found):
            yield rows([], [], np.r_[found, -1, -2], np.r_[seen[found], totals])

    pairs = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text")
    written = staged(spark, pairs.mapInArrow(encoded, "doc_id long, ids binary, term int, n long"), "token-ids")
    sums = written.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist()))
    total, length = counts.pop(-1, 0), counts.pop(-2, 0)
    seen = np.zeros(IDS)
    seen[list(counts)] = list(counts.values())
    idf = np.log(1 + (total - seen + 0.5) / (seen + 0.5))
    return written.filter("term is null").select("doc_id", "ids"), Corpus(idf, length / max(total, 1))


class Shard:
    """Inverted index over the parts of documents that do not fill a window, each cut and used up as windows are filled."""

    def __init__(self, parts: list[np.ndarray], corpus: Corpus) -> None:
        self.lengths = np.array([len(p) for p in parts], np.int64)
        owner = np.repeat(np.arange(len(parts)), self.lengths)
        pairs, times = np.unique(np.concatenate(parts).astype(np.int64) * len(parts) + owner, return_counts=True)
        terms, self.docs = pairs // len(parts), pairs % len(parts)
        norm = K1 * (1 - B + B * self.lengths / max(corpus.mean_length, 1.0))
        self.weights = corpus.idf[terms] * times * (K1 + 1) / (times + norm[self.docs])
        self.ends = np.searchsorted(terms, np.arange(IDS + 1))
        # The same pairs by part, for queries.
        by_part = np.argsort(self.docs, kind="stable")
        self.queries = terms[by_part]
        self.first = np.searchsorted(self.docs[by_part], np.arange(len(parts) + 1))
        self.terms = terms
        self.left = self.lengths.copy()
        self.next, self.indexed = 0, len(parts)

    def shrink(self) -> None:
        """Leave parts that are used up out of the lists, once a fifth of those in them is."""
        unused = np.count_nonzero(self.left)
        if 5 * unused <= 4 * self.indexed:
            kept = self.left[self.docs] > 0
            self.terms, self.docs, self.weights = self.terms[kept], self.docs[kept], self.weights[kept]
            self.ends = np.searchsorted(self.terms, np.arange(IDS + 1))
            self.indexed = unused

    def neighbours(self, seed: int) -> Iterator[np.ndarray]:
        """Unused parts by falling BM25 score for all terms of the seed, some at a time down the whole ranking; ties by place."""
        self.shrink()
        query = self.queries[self.first[seed] : self.first[seed + 1]]
        spans = [slice(a, b) for a, b in zip(self.ends[query].tolist(), self.ends[query + 1].tolist()) if a < b]
        if not spans:
            return
        score = np.bincount(
            np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), len(self.left)
        )
        found = np.flatnonzero((score > 0) & (self.left > 0))
        while len(found) > NEIGHBOURS:
            # All that tie with the last of the block come with it, so that places decide among them.
            lowest = np.partition(score[found], -NEIGHBOURS)[-NEIGHBOURS]
            near = score[found] >= lowest
            block, found = found[near], found[~near]
            yield block[np.argsort(-score[block], kind="stable")]
        yield found[np.argsort(-score[found], kind="stable")]

    def unused(self) -> int:
        while self.next < len(self.left) and not self.left[self.next]:
            self.next += 1
        return self.next if self.next < len(self.left) else -1

    def fill(self, room: int) -> Iterator[tuple[int, int, int]]:
        """Parts for a window: (part, start in it, length), the seed first, until the room or the shard is used up."""

        def take(part: int, most: int) -> tuple[int, int, int]:
            length = int(min(self.left[part], most))
            start = int(self.lengths[part] - self.left[part])
            self.left[part] -= length
            return part, start, length

        while room and (seed := self.unused()) >= 0:
            piece = take(seed, room)
            room -= piece[2]
            yield piece
            for near in self.neighbours(seed) if room else ():
                for part in near:
                    if 0 < self.left[part] <= room:
                        piece = take(part, room)
                        room -= piece[2]
                        yield piece
                for part in near:
                    if room and self.left[part]:
                        piece = take(part, room)
                        room -= piece[2]
                        yield piece
                if not room:
                    break


def pack(
    spark: SparkSession, docs: DataFrame, ranks_path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit ids; each document ends with id 0, so that null or empty text is that id
    alone. Full windows of a document are sequences of their own; what is left of it is packed with its neighbours. A shard is
    a stretch of one task's rows, so nothing is shuffled: its window opens with the first unused part, neighbours that fit
    whole are added by falling score, then the best one that does not is cut, and the next unused part follows if the window
    is still open. Only the last sequence of a task can be short.

    Rows with the same doc_id are separate documents of their own pieces, null doc_ids stay null, ties go to the earlier row.
    Empty tables give no rows, and other columns are not read. ``sequence_id`` is unique; it depends on how the input is
    split into tasks.
    """
    encoded, counts = tokenised(spark, docs, ranks_path or tokens.default_ranks())
    corpus = spark.sparkContext.broadcast(counts)
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = count(TaskContext.get().partitionId() << 33)
        opened, offset = next(free), 0
        rows: list[tuple] = []
        parts: list[tuple] = []  # doc_id, ids, start of the part
        waiting = 0

        def piece(doc_id, ids: np.ndarray, start: int, length: int, sequence: int, at: int) -> None:
            rows.append((doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), sequence, at))

        def fill_windows() -> None:
            nonlocal opened, offset
            shard = Shard([ids[at:] for _, ids, at in parts], corpus.value)
            while shard.unused() >= 0:
                for part, start, length in shard.fill(window - offset):
                    doc_id, ids, at = parts[part]
                    piece(doc_id, ids, at + start, length, opened, offset)
                    offset += length
                if offset == window:
                    opened, offset = next(free), 0
            parts.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in sliced(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(ids, "<u2")
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    piece(doc_id, ids, start, window, next(free), 0)
                if whole < len(ids):
                    parts.append((doc_id, ids, whole))
                    waiting += len(ids) - whole
                if waiting >= shard_tokens:
                    fill_windows()
                    waiting = 0
                if len(rows) >= 1024:
                    yield out()
        if parts:
            fill_windows()
        if rows:
            yield out()

    return encoded.mapInArrow(packed, schema)
