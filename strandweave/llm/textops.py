"""Byte-level word hashing in numpy, used by the Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_BLOCK = 1 << 16
_POWERS = np.ones(_BLOCK, dtype=np.uint64)
_POWERS[1:] = _BASE
_POWERS = np.multiply.accumulate(_POWERS)
_STEP = pow(_BASE, _BLOCK, 1 << 64)

#: Bytes that end a word: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and nothing else.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Texts are hashed in groups of about this many bytes.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of about CHUNK_BYTES each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each text's first word (n + 1 bounds).

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z
    lower-cased.
    """
    return word_spans(texts, _SPACE)[:2]


def word_spans(texts: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with words parted by the bytes that ``parts`` marks; also where in the
    texts, joined with one byte between them, words start and end.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~parts[buf]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds, starts, starts
    stops = np.flatnonzero(edge == -1)
    length = stops - starts
    first = np.cumsum(length) - length
    body = _LOWER[buf[inside]]
    off = np.arange(len(body)) - np.repeat(first, length)
    value = _TABLE[body] * _POWERS[off & (_BLOCK - 1)]
    for k in range(1, int(off.max()) // _BLOCK + 1):
        at = off >= k * _BLOCK
        value[at] *= np.uint64(_STEP)
    hashes = np.add.reduceat(value, first) + length.astype(np.uint64)
    return mix(hashes), bounds, starts, stops


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct word shingles as sorted 64-bit hashes.

    A text with fewer words than ``width`` has one shingle, the whole word
    sequence; a text without words has none.
    """
    odd = np.uint64(0x9E3779B97F4A7C15)
    for a, b in chunks(texts):
        words, bounds = word_hashes(texts[a:b])
        n = len(words) - width + 1
        rolled = words[: max(n, 0)].copy()
        for j in range(1, width):
            rolled = mix(rolled * odd + words[j : j + n]) if n > 0 else rolled
        for i in range(b - a):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                acc = words[lo : lo + 1].copy()
                for j in range(lo + 1, hi):
                    acc = mix(acc * odd + words[j : j + 1])
                yield mix(acc + np.uint64(hi - lo))
            else:
                yield np.zeros(0, dtype=np.uint64)
