"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableferry.llm.features import document_frequencies, has_letter, inverse_frequencies, letter_counts, weighted
from tableferry.llm.store import sliced

DIMS = 8192
# At most this many labelled rows of each language are learned from, and of all languages together.
SAMPLE, SAMPLED = 1024, 1 << 16
FOLDS, HELD_OUT = 4, 2
# Follow the regularised leader: step size, its start, and the elastic net.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.0005
EPOCHS = 3
UNKNOWN = "und"


@dataclass
class Model:
    idf: np.ndarray
    weights: np.ndarray
    languages: list[str]
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            if not self.languages or not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            chance = softmax(_logits(self.weights, text, self.idf) / self.temperature)
            best = int(chance.argmax())
            names.append(self.languages[best])
            scores.append(float(chance[best]))
        return names, scores


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sparse(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bins = np.flatnonzero(counts)
    return bins, weighted(counts[bins], idf[bins])


def _logits(weights: np.ndarray, text: str, idf: np.ndarray) -> np.ndarray:
    bins, values = _sparse(letter_counts(text, DIMS), idf)
    return values @ weights[bins] + weights[-1]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Proximal follow-the-regularised-leader with an elastic net; one weight row per bin, the last for the intercept."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def solved(bins: np.ndarray | slice) -> np.ndarray:
        kept = np.sign(z[bins]) * np.maximum(np.abs(z[bins]) - L1, 0)
        return -kept / ((BETA + np.sqrt(n[bins])) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            bins, values, label = rows[i]
            at, x = np.r_[bins, DIMS], np.r_[values, 1.0][:, None]
            w = solved(at)
            error = softmax((x * w).sum(axis=0))
            error[label] -= 1
            gradient = x * error
            squared = gradient**2
            z[at] += gradient - (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squared
    return solved(slice(None))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least cross entropy on rows that training did not see."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Weights from a bounded, seeded sample of labelled rows for each language; document frequencies from all labelled rows.

    Held-out rows and rows without lang are not read. The sample is the first ``sample`` rows of each language in the order of a
    hash of doc_id, and as many fewer of each as keep all together to ``SAMPLED``. Ids are ranked without text; only their
    features reach the driver. One row in five is left out of the training and sets the temperature.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    docs = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (fold != HELD_OUT))
    known = docs.select("doc_id", "lang")
    names = sorted(r.lang for r in known.select("lang").distinct().collect())
    sample = max(1, min(sample, SAMPLED // max(1, len(names))))
    # One row of a language in a hash range is enough for the next: ranks are taken inside 64 ranges first.
    place = F.xxhash64("doc_id")
    near = known.withColumn("place", place).withColumn("range", F.pmod("place", F.lit(64)))
    first = Window.partitionBy("lang", "range").orderBy("place", "doc_id")
    ids = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= -(-sample // 64)).select("doc_id", "lang")
    ids = ids.distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bins, counts = [], []
            for text in batch.column("text").to_pylist():
                row = letter_counts(text or "", DIMS)
                found = np.flatnonzero(row)
                bins.append(found.astype(np.uint16).tobytes())
                counts.append(row[found].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(bins, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "lang", "bins", "counts"],
            )

    rows = (
        docs.select("doc_id", "text", "lang")
        .join(F.broadcast(ids), ["doc_id", "lang"])
        .mapInArrow(features, "doc_id long, lang string, bins binary, counts binary")
        .groupBy("doc_id", "lang")
        .agg(F.min(F.struct("bins", "counts")).alias("row"))
        .select("doc_id", "lang", "row.*")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("lang", "ascending")])
        .to_pylist()
    )
    seen, texts = document_frequencies(docs, letter_counts, DIMS)
    idf = inverse_frequencies(seen, texts)
    learned = []
    for row in rows:
        bins = np.frombuffer(row["bins"], np.uint16).astype(np.int64)
        values = weighted(np.frombuffer(row["counts"], np.uint32).astype(float), idf[bins])
        learned.append((bins, values, names.index(row["lang"])))
    if not learned:
        return Model(idf, np.zeros((DIMS + 1, 1)), [], 1.0)
    weights = train([r for i, r in enumerate(learned) if i % 5], len(names))
    aside = learned[::5]
    logits = np.array([values @ weights[bins] + weights[-1] for bins, values, _ in aside])
    return Model(idf, weights, names, calibrate(logits, np.array([label for *_, label in aside])))


def identify(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    The prediction reads the whole text and nothing else. Null text and text without a letter is ``und`` with score 0, and
    so is everything if no row is labelled. A null doc_id is not held out, and is not learned from. Ties go to the first
    language by code point; of rows that repeat a doc_id and language one text is learned. Empty tables give no rows, and
    other columns are not read.
    """
    model = spark.sparkContext.broadcast(fit(spark, docs, sample))

    def predicted(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in columns:
            names, scores = model.value.predict(list(texts))
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype="float64")})

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    found = F.pandas_udf(predicted, "lang_pred string, score double")("text")
    held = F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")
