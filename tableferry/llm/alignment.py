"""Alignment of two tokenizers over a corpus: each distinct text is cut and aligned once, pairs are counted by documents."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tableferry.llm import tokens
from tableferry.llm.store import sliced, staged

# A pair is one number: A's id, then B's id in so many bits.
B_BITS = 15
A_IDS, B_IDS = 1 << 16, 1 << B_BITS
# A chunk of texts ends with the one that brings its different pairs, text by text, to this many; a text counts as EACH more.
CHUNK_PAIRS, EACH = 1 << 22, 16
# Rows of pairs handed on at a time.
ROWS = 100_000
# Between two of these characters a space is a border: no piece of B holds a space after another character, and A's pattern
# starts a token there. Words are cut this many at a time; longer ones are not kept, and a full table starts anew.
BORDER = re.compile(r"(?<=[!-~]) (?=[!-~])")
TOGETHER, KEPT_LENGTH, KEPT_WORDS = 4096, 48, 3 << 17
MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


@dataclass(frozen=True)
class Pieces:
    """The tokens of one vocabulary as bytes, by id, and their lengths."""

    texts: list[bytes]
    lengths: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Pieces:
        return cls(texts, np.array([len(t) for t in texts], np.int64))


@cache
def left_pieces(ranks_path: str) -> Pieces:
    """Tokenizer A: byte-level, so that an entry of the rank file is its token's bytes."""
    with open(ranks_path, "rb") as lines:
        known = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return Pieces.of([known.get(i, b"") for i in range(max(known) + 1)])


@cache
def right_model(model_path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if model.get_piece_size() > B_IDS:
        raise ValueError(f"ids must fit {B_BITS} bits")
    return model


@cache
def right_pieces(model_path: str) -> Pieces:
    """Tokenizer B: pieces in UTF-8 with U+2581 for a space; a byte piece is its byte, control pieces are nothing."""
    model = right_model(model_path)

    def raw(i: int) -> bytes:
        if model.is_byte(i):
            return bytes([int(model.id_to_piece(i)[3:-1], 16)])
        return b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace("▁", " ").encode()

    return Pieces.of([raw(i) for i in range(model.get_piece_size())])


@cache
def _crosses(model_path: str) -> bool:
    """Whether any piece of B reaches from another character over a space."""
    model = right_model(model_path)
    return any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))


@cache
def _written(ranks_path: str, model_path: str) -> tuple[list[bytes], np.ndarray]:
    """How each id is written, and how long: A's before a comma, A's last of a group, B's before a comma, B's last of a group."""
    a, b = range(len(left_pieces(ranks_path).texts)), range(len(right_pieces(model_path).texts))
    texts = [b"%d%b" % (i, mark) for ids, mark in ((a, b","), (a, b"|"), (b, b","), (b, b";")) for i in ids]
    return texts, np.array([len(t) for t in texts])


class Aligned(NamedTuple):
    """Both tokenizers' ids of a text; ``codes`` are its links as 32-bit numbers, ``line`` its groups, each ended by ``;``."""

    n_a: int
    n_b: int
    n_groups: int
    codes: bytes
    line: bytes


def align_words(words: list[str], ranks_path: str, model_path: str) -> list[Aligned | None]:
    """The ids of each word after a space, cut into groups where both tokenizers end; None if they do not spell it.

    Words are cut in one go, with spaces between, so neither tokenizer may reach over a border between them. Byte ranges of two
    tokens overlap in one stretch without an end of either inside: links are the stretches between neighbouring ends of any kind.
    """
    text = " ".join(words)
    whole = (" " + text).encode("utf-8", "replace")
    left, right = left_pieces(ranks_path), right_pieces(model_path)
    b = right_model(model_path).encode(text)
    if b"".join(map(right.texts.__getitem__, b)) != whole:
        if len(words) == 1:
            return [None]
        half = len(words) // 2
        return align_words(words[:half], ranks_path, model_path) + align_words(words[half:], ranks_path, model_path)
    a, b = np.array(tokens.ordinary(" " + text, ranks_path)), np.array(b)
    mark = np.zeros(len(whole) + 1, np.uint8)
    mark[np.cumsum(left.lengths[a])] = 1
    mark[np.cumsum(right.lengths[b])] |= 2
    ends = np.flatnonzero(mark)
    mark = mark[ends]
    of_a, of_b, both = mark & 1, mark >> 1, mark == 3
    seen_a, seen_b, seen = (np.cumsum(x, dtype=np.int64) for x in (of_a, of_b, both))
    codes = ((a[seen_a - of_a] << B_BITS) | b[seen_b - of_b]).astype("<u4").tobytes()
    # A group is written with its A tokens first: an A token stands after the B tokens of earlier groups only.
    group = seen - both
    at_a, at_b = np.flatnonzero(of_a), np.flatnonzero(of_b)
    order = np.empty(len(a) + len(b), np.int64)
    count_a, count_b = len(left.texts), len(right.texts)
    order[np.arange(len(a)) + np.r_[0, seen_b[both]][group[at_a]]] = a + np.where(both[at_a], count_a, 0)
    order[np.arange(len(b)) + seen_a[both][group[at_b]]] = b + 2 * count_a + np.where(both[at_b], count_b, 0)
    texts, lengths = _written(ranks_path, model_path)
    line = b"".join(map(texts.__getitem__, order.tolist()))
    # Where each word ends: in bytes, in stretches, and in the written line.
    last = np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in words])
    last = np.searchsorted(ends, last)
    written = np.r_[0, np.cumsum(lengths[order])][seen_a[last] + seen_b[last]]
    bounds = [np.r_[0, x].tolist() for x in (seen_a[last], seen_b[last], seen[last], 4 * (last + 1), written)]
    steps = [list(zip(x, x[1:])) for x in bounds]
    return [
        Aligned(a1 - a0, b1 - b0, g1 - g0, codes[c0:c1], line[l0:l1])
        for (a0, a1), (b0, b1), (g0, g1), (c0, c1), (l0, l1) in zip(*steps)
    ]


@cache
def _known(ranks_path: str, model_path: str) -> dict[str, Aligned | None]:
    return {}


def align(texts: list[str], ranks_path: str, model_path: str) -> list[Aligned | None]:
    """Each text with a space before it, aligned; None where the tokenizers do not spell it.

    Between words both tokenizers end, so a text is put together of words that are cut once and kept for a while.
    """
    known = _known(ranks_path, model_path)
    split = [[t] if _crosses(model_path) else BORDER.split(t) for t in texts]
    missing = dict.fromkeys(w for words in split for w in words if w not in known)
    plain = [w for w in missing if w and "!" <= w[0] <= "~" and "!" <= w[-1] <= "~"]
    for at in range(0, len(plain), TOGETHER):
        part = plain[at : at + TOGETHER]
        known.update(zip(part, align_words(part, ranks_path, model_path)))
    for word in missing:
        if word not in known:
            known[word] = align_words([word], ranks_path, model_path)[0]
    out: list[Aligned | None] = []
    for words in split:
        found = list(map(known.__getitem__, words))
        if None in found:
            out.append(None)
            continue
        n_a, n_b, n_groups, codes, lines = zip(*found)
        out.append(Aligned(sum(n_a), sum(n_b), sum(n_groups), b"".join(codes), b"".join(lines)))
    if len(known) > KEPT_WORDS:
        known.clear()
    for word in missing:
        if len(word) > KEPT_LENGTH:
            known.pop(word, None)
    return out


def _packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and how often each occurs: steps and counts byte by byte, compressed."""
    flat = np.r_[np.diff(at, prepend=0), times].astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    flat = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(flat[: len(flat) // 2]), flat[len(flat) // 2 :]


def _encoded(spark: SparkSession, texts: DataFrame, ranks_path: str, model_path: str, chunk_pairs: int) -> DataFrame:
    """Distinct texts by chunk and, beside them, the chunk's different pairs with the documents that hold them; written once.

    A text's row has its measures and ``found``, its pairs as places in the chunk's ascending pairs; a pair's row has ``pair, n``.
    """
    schema = f"chunk long, digest binary, {MEASURES}, found binary, pair int, n long"
    fields = [c.split()[0] for c in schema.split(", ")]
    types = {"chunk": pa.int64(), "digest": pa.binary(), "groups_sha256": pa.string(), "found": pa.binary(), "pair": pa.int32()}

    def batch_of(size: int, **columns) -> pa.RecordBatch:
        made = [pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(size, types.get(c, pa.int64())) for c in fields]
        return pa.RecordBatch.from_arrays(made, fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        waiting: list[tuple[bytes, int, tuple, np.ndarray, np.ndarray]] = []

        def closed() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(w[3]) for w in waiting])
            codes, place = np.unique(np.concatenate([w[3] for w in waiting]), return_inverse=True)
            n = np.bincount(place, weights=np.repeat([float(w[1]) for w in waiting], sizes)).astype(np.int64)
            for at in range(0, len(codes), ROWS):
                part = codes[at : at + ROWS]
                yield batch_of(len(part), chunk=np.full(len(part), chunk), pair=part.astype(np.int32), n=n[at : at + ROWS])
            ends = np.r_[0, np.cumsum(sizes)]
            for at in range(0, len(waiting), 1000):
                part = waiting[at : at + 1000]
                yield batch_of(
                    len(part), chunk=np.full(len(part), chunk), digest=[w[0] for w in part],
                    n_a=[w[2][0] for w in part], n_b=[w[2][1] for w in part], n_groups=[w[2][2] for w in part],
                    n_links=[int(w[4].sum()) for w in part], groups_sha256=[w[2][3] for w in part],
                    found=[_packed(place[ends[at + i] : ends[at + i + 1]], w[4]) for i, w in enumerate(part)],
                )
            waiting.clear()

        for batch in sliced(batches):
            digests, copies, texts = (batch.column(c).to_pylist() for c in ("digest", "copies", "text"))
            for digest, times_held, found in zip(digests, copies, align(texts, ranks_path, model_path)):
                if found is None:
                    continue
                codes, times = np.unique(np.frombuffer(found.codes, "<u4"), return_counts=True)
                sha = hashlib.sha256(memoryview(found.line)[:-1]).hexdigest()
                waiting.append((digest, times_held, (*found[:3], sha), codes, times))
                held += len(codes) + EACH
                if held >= chunk_pairs:
                    yield from closed()
                    chunk, held = chunk + 1, 0
        if waiting:
            yield from closed()

    return staged(spark, texts.select("digest", "copies", "text").mapInArrow(encode, schema), "aligned")


def alignments(
    spark: SparkSession, docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, chunk_pairs: int = CHUNK_PAIRS
) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Documents are shuffled by their whole text, so that each distinct text is cut by both tokenizers and aligned once, however
    many copies it has. Chunks of texts name their different pairs of linked ids, weighted by copies; the sum of a pair over
    all chunks is the number of documents that hold it, and goes back to the chunks that asked. However frequent, a pair has
    one row per chunk. Only the highest count of each A id, at most 65,536 numbers, is sent to all tasks. Measures join
    their documents by SHA-256 of the text.

    Null and empty texts, and texts that B's pieces do not spell byte for byte, have no tokens: zeros and ''. Strings of
    special tokens are plain text. Rows that repeat a doc_id, or have none, are documents of their own text. An empty table
    gives no rows, and other columns are not read.
    """
    import public_tokenizers

    ranks_path = ranks_path or tokens.default_ranks()
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    texts = docs.select("text").filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    encoded = _encoded(spark, texts, ranks_path, model_path, chunk_pairs)
    total = F.sum("n").over(Window.partitionBy("pair"))
    pairs = encoded.filter("pair is not null").select("chunk", "pair", "n").select("chunk", "pair", total.alias("n"))
    pairs = staged(spark, pairs, "pair-counts")
    most = pairs.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("n")).toArrow()
    highest = np.zeros(A_IDS, np.int64)
    highest[most.column("a").to_numpy()] = most.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(highest)

    def summed(documents: pa.Table, known: pa.Table) -> pa.Table:
        pair = known.column("pair").to_numpy()
        order = np.argsort(pair)
        n = known.column("n").to_numpy()[order]
        best = n == shared.value[pair[order] >> B_BITS]
        sums = np.zeros((2, documents.num_rows), np.int64)
        for i, packed in enumerate(documents.column("found").to_pylist()):
            at, times = _unpacked(packed)
            sums[:, i] = times[best[at]].sum(), (n[at] * times).sum()
        out = documents.drop_columns(["chunk", "found"])
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    measured = encoded.filter("found is not null").drop("pair", "n").groupBy("chunk").cogroup(pairs.groupBy("chunk"))
    measured = staged(spark, measured.applyInArrow(summed, f"digest binary, {MEASURES}, n_best long, count_sum long"), "measures")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.join(measured, "digest", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")
    )
