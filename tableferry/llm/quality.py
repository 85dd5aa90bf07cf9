"""Quality by nearest-neighbour voting among labelled texts in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm.features import document_frequencies, inverse_frequencies, shape_counts, word_counts
from tableferry.llm.store import sliced

# Terms: hashed words, n-grams of character classes, and the shares of words that repeat and do not repeat the one before.
WORDS, SHAPES = 1 << 14, 1 << 11
DIMS = WORDS + SHAPES + 2
# The squared length of each kind of terms in the vector of a text that has all three.
WORD_PART, SHAPE_PART, REPEAT_PART = 0.4, 0.4, 0.2
RANK = 64
# Steps of the subspace iteration that finds the axes, and directions it carries besides.
STEPS, SPARE = 6, 8
NEIGHBOURS = 15
# The classifier is fitted on this many labelled rows, the first in a seeded order: its only bound.
SAMPLE = 4096
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
# Rows of one product of documents and labelled vectors.
BLOCK = 256


def term_counts(text: str, dims: int = DIMS) -> np.ndarray:
    words, repeats = word_counts(text, WORDS)
    return np.concatenate([words, shape_counts(text, SHAPES), [repeats, words.sum() - repeats]])


def term_weights(bins: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of the words and of the shapes, each scaled to its part, and the roots of both shares of words."""
    out = np.log1p(counts) * idf[bins]
    words, shapes = np.searchsorted(bins, [WORDS, WORDS + SHAPES])
    for part, length in ((out[:words], WORD_PART), (out[words:shapes], SHAPE_PART)):
        part *= np.sqrt(length) / max(np.linalg.norm(part), 1e-12)
    out[shapes:] = np.sqrt(REPEAT_PART * counts[shapes:] / max(counts[shapes:].sum(), 1.0))
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def main_axes(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leading right singular vectors of sparse rows (bins, weights), by seeded subspace iteration over dense blocks."""

    def applied(turn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(rows), BLOCK):
            dense = np.zeros((len(rows[at : at + BLOCK]), DIMS), np.float32)
            for line, (bins, weights) in zip(dense, rows[at : at + BLOCK]):
                line[bins] = weights
            yield dense, dense @ turn

    turn = np.random.default_rng(7).standard_normal((DIMS, RANK + SPARE)).astype(np.float32)
    for _ in range(STEPS):
        turn = np.linalg.qr(sum(dense.T @ seen for dense, seen in applied(turn)))[0]
    products = sum(seen.T @ seen for _, seen in applied(turn))
    return (turn @ np.linalg.eigh(products.astype(float))[1][:, -RANK:]).astype(np.float32)


@dataclass
class Space:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, texts: list[str]) -> np.ndarray:
        flat = np.zeros((len(texts), self.axes.shape[1]))
        for row, text in zip(flat, texts):
            counts = term_counts(text)
            bins = np.flatnonzero(counts)
            row[:] = term_weights(bins, counts[bins], self.idf) @ self.axes[bins]
        return unit(flat)

    def vote(self, texts: list[str]) -> np.ndarray:
        """The share of label 1 among the nearest, each with the eighth power of its cosine as its weight."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(texts), prior)
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            cosines = self.place(texts[at : at + BLOCK]) @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0.0).astype(float) ** 8
            total = weight.sum(axis=1)
            share = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[at : at + BLOCK] = np.where(total > 1e-9, share, prior)
        return out


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    """Axes and labelled vectors of word TF-IDF, with shapes as further terms. Document frequencies come from all documents, axes from the labelled sample.

    The sample is chosen among the labels before any text is read, so only ``sample`` ids are broadcast and only their
    terms (at most ``DIMS`` pairs of bin and count each) reach the driver. Labels that are null or whose doc_id is null or held out
    are not learned from; a doc_id with several labels takes the smallest.
    """
    usable = labels.filter(F.col("quality").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(
        F.min("quality").alias("label")
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bins, counts = [], []
            for text in batch.column("text").to_pylist():
                row = term_counts(text or "")
                found = np.flatnonzero(row)
                bins.append(found.astype(np.uint16).tobytes())
                counts.append(row[found].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(bins, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "label", "bins", "counts"],
            )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.col("label").cast("long").alias("label"), "text")
        .mapInArrow(features, "doc_id long, label long, bins binary, counts binary")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.min(F.struct("bins", "counts")).alias("terms"))
        .select("doc_id", "label", "terms.*")
        .toArrow()
        .sort_by("doc_id")
    )
    seen, texts = document_frequencies(docs, term_counts, DIMS)
    space = Space(inverse_frequencies(seen, texts), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    if rows.num_rows:
        learned = []
        for bins, counts in zip(rows.column("bins").to_pylist(), rows.column("counts").to_pylist()):
            at = np.frombuffer(bins, np.uint16)
            learned.append((at, term_weights(at, np.frombuffer(counts, np.uint32), space.idf).astype(np.float32)))
        space.axes = main_axes(learned)
        space.vectors = unit(np.stack([weights @ space.axes[bins] for bins, weights in learned]))
        space.labels = (np.array(rows.column("label").to_pylist()) > 0).astype(float)
    return space


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, into: str = "score", sample: int = SAMPLE, frame: DataFrame | None = None) -> DataFrame:
    """``docs``, or ``frame`` if given, with one more column: the score of each whole text, 0 to 1; higher means label 1 is likelier.

    Every document is compared with every labelled vector, in blocks; the labelled vectors are at most ``sample`` times
    ``RANK`` numbers, so they are broadcast. Null text counts as empty; a text without a direction gets the share of label 1
    among the learned rows; without labels every score is 0.5. Ties between neighbours are broken by place in the
    seeded order. Of rows that repeat a doc_id one text is learned. Repeated rows are scored alike, an empty table stays empty, and a column called ``into`` is replaced.
    """
    space = spark.sparkContext.broadcast(fit(spark, docs, labels, sample))

    def votes(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            yield pd.Series(space.value.vote([t or "" for t in texts]), dtype="float64")

    return (docs if frame is None else frame).withColumn(into, F.pandas_udf(votes, "double")("text"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(spark, docs.select("doc_id", "text"), labels)
    return scored.select(
        "doc_id",
        F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, whatever those are called; nulls as in ``score``."""
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    kept = score(spark, docs.select("doc_id", "text"), labels, "quality", frame=rows).filter(F.col("quality") >= THRESHOLD)
    return kept.select("row.*")
