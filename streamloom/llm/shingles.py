"""Word shingles of many texts at once, on the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)[_LOWER]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial hash and inverse powers of its base: values a to b hash to
    ``(sums[b] - sums[a]) * inverse[a]`` wherever they stand."""
    power = np.full(len(values), BASE)
    power[:1] = 1
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * np.cumprod(power), out=sums[1:])
    power[1:] = _INVERSE
    return sums, np.cumprod(power)


def byte_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about ``size`` bytes; null texts are empty."""
    if not len(column):
        return
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32).astype(np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        end = min(end, len(column))
        yield start, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at white space), and where each text's begin."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = np.empty(len(data) + 1, bool)
    space[:-1] = _SPACE[data]
    space[-1] = True
    cut = np.zeros(len(data) + 1, bool)  # a text begins here
    cut[offsets] = True
    begins = np.flatnonzero(~space[:-1] & (np.concatenate([[True], space[:-2]]) | cut[:-1]))
    ends = np.flatnonzero(~space[:-1] & (space[1:] | cut[1:])) + 1
    sums, inverse = prefix_hashes(_BYTE[data])
    hashes = (sums[ends] - sums[begins]) * inverse[begins]
    return mixed(hashes + (ends - begins).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(begins, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words, and where each text's begin. A text of fewer words has
    its whole sequence as one; a text without words has none."""
    hashes, first = word_hashes(data, offsets)
    count = np.diff(first)
    have = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(have)])
    begin = np.arange(at[-1]) - np.repeat(at[:-1], have) + np.repeat(first[:-1], have)
    long = np.minimum(np.repeat(count, have), words)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    out = long.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for i in range(words):
        out = mixed(out * BASE + np.where(i < long, padded[begin + i], np.uint64(0)))
    return out, at


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in byte_slices(column):
        hashes, at = shingle_hashes(data, offsets, words)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(hashes[a:b])
