"""Hashes of words and shingles of whole texts, taken over all bytes of a text at once."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
# Bytes that separate words; the bytes of A-Z count as those of a-z.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = 64


def _byte_hashes() -> np.ndarray:
    """One random 64-bit number for each byte at each of the first places of a word."""
    table = np.random.default_rng(20240607).integers(1, 1 << 64, (_PLACES, 256), np.uint64)
    table[:, 65:91] = table[:, 97:123]
    return table.ravel()


_BYTES = _byte_hashes()
_STEPS = np.random.default_rng(11).integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that every bit depends on all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text, where its words start, and 64-bit hashes of the lower-cased words; white space separates them."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    space = SPACE[raw]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return raw, starts, np.zeros(0, np.uint64)
    at = starts[0]
    place = np.arange(at, len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    sums = _BYTES[(place % _PLACES) * 256 + raw[at:]]
    if place.max() >= _PLACES:
        sums = sums * (np.uint64(2) * (place // _PLACES).astype(np.uint64) + np.uint64(1))
    sums[space[at:]] = 0
    return raw, starts, mixed(np.add.reduceat(sums, starts - at))


def word_hashes(text: str | None) -> np.ndarray:
    return words_of(text)[2]


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words are one run."""
    if not len(words):
        return words
    if len(words) < size:
        return mixed((words * _STEPS[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    total = words[: len(words) - size + 1] * _STEPS[0]
    for i in range(1, size):
        total = total + words[i : len(words) - size + 1 + i] * _STEPS[i]
    return mixed(total)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(word_hashes(text)))
