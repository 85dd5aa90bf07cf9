"""Hashed n-gram counts of whole texts, and corpus counts over them."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.llm.store import sliced

# Classes of characters: letters by case, digits, white space, line ends; every other sign by its code.
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _SIGN = 1, 2, 3, 4, 5, 8
_KNOWN = 0x3000
# Runs of letters and digits; in scripts written without spaces every sign is a word.
_WORD = re.compile("[\u3040-\u30ff\u3400-\u9fff]|[^\\W_\u3040-\u30ff\u3400-\u9fff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    out = np.zeros(_KNOWN, np.uint8)
    for code in range(_KNOWN):
        kind, sign = unicodedata.category(chr(code)), chr(code)
        if sign in "\r\n":
            out[code] = _LINE
        elif sign.isspace():
            out[code] = _SPACE
        elif kind in ("Lu", "Lt"):
            out[code] = _UPPER
        elif kind[0] in "LM":
            out[code] = _LOWER
        elif kind[0] == "N":
            out[code] = _DIGIT
        else:
            out[code] = _SIGN + code % 56
    return out


CLASSES = _classes()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _class_of(codes: np.ndarray) -> np.ndarray:
    """Beyond the table nearly all characters are letters of scripts without case."""
    return np.where(codes < _KNOWN, CLASSES[np.minimum(codes, _KNOWN - 1)], np.uint8(_LOWER))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _add_grams(out: np.ndarray, symbols: np.ndarray, longest: int, base: int) -> None:
    """Count all n-grams of up to ``longest`` symbols into ``out``, whose length is a power of two."""
    shift = np.uint64(64 - int(out.size).bit_length() + 1)
    code = symbols = symbols.astype(np.uint64)
    for n in range(1, longest + 1):
        bins = (code * (_MIX + np.uint64(2 * n))) >> shift
        out += np.bincount(bins.astype(np.int64), minlength=out.size)
        if len(code) < 2:
            return
        code = code[:-1] * np.uint64(base) + symbols[n:]


def shape_counts(text: str, dims: int) -> np.ndarray:
    """N-grams of up to five character classes with runs drawn together."""
    out = np.zeros(dims)
    codes = code_points(text)
    if len(codes):
        kinds = _class_of(codes)
        _add_grams(out, kinds[np.r_[True, kinds[1:] != kinds[:-1]]], 5, 67)
    return out


def word_counts(text: str, dims: int) -> tuple[np.ndarray, int]:
    """Lower-cased words, hashed, and how many of them repeat the one before."""
    out = np.zeros(dims)
    words = _WORD.findall(text.lower())
    for word, n in Counter(words).items():
        out[zlib.crc32(word.encode("utf-8", "replace")) % dims] += n
    return out, sum(map(str.__eq__, words, words[1:]))


def letter_counts(text: str, dims: int) -> np.ndarray:
    """N-grams of up to four characters of the lower-cased letters; everything between words is one space."""
    out = np.zeros(dims)
    codes = code_points(text.lower())
    if not len(codes):
        return out
    kinds = _class_of(codes)
    letter = (kinds == _LOWER) | (kinds == _UPPER)
    symbols = np.where(letter, codes, 32)
    symbols = symbols[letter | np.r_[True, letter[:-1]]]
    _add_grams(out, np.r_[32, symbols, 32].astype(np.uint64), 4, 0x110000 | 1)
    return out


def document_frequencies(docs: DataFrame, counts: Callable[[str, int], np.ndarray], dims: int) -> tuple[np.ndarray, int]:
    """In how many texts each bin occurs, and the number of texts, over all rows. Only ``dims`` sums reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(dims + 1, np.int64)
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen[:dims] += counts(text or "", dims) > 0
                seen[dims] += 1
        bins = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(seen[bins])], ["bin", "n"])

    sums = docs.select("text").mapInArrow(tally, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(dims + 1, np.int64)
    for row in sums:
        out[row.bin] = row.n
    return out[:dims], int(out[dims])


def inverse_frequencies(seen: np.ndarray, texts: int) -> np.ndarray:
    return np.log((1 + texts) / (1 + seen)) + 1


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of logarithmic counts times inverse document frequency, scaled to length 1; a row of zeros stays."""
    out = np.log1p(counts) * idf
    return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-12)
