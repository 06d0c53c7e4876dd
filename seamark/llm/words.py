"""Hashes of the words and word shingles of a batch of texts, by numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``, with A-Z lower-cased on demand. Its
64-bit hash is a polynomial in a random odd base over random values of its
bytes, finished by a mixer; prefix sums over the batch give all words at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_SECOND_BASE = 0xC2B2AE3D27D4EB4F
_STEP = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], np.uint64)
#: Bytes of text read together.
SLICE_BYTES = 1 << 20
#: Bytes hashed together; a worker keeps two tables of as many powers for each base.
STRETCH_BYTES = (1 << 18) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    if fold:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUES = {fold: _byte_values(fold) for fold in (True, False)}


@functools.lru_cache(maxsize=2)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    def table(b: int) -> np.ndarray:
        out = np.full(size, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(base), table(pow(base, -1, 1 << 64))


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool, base: int) -> np.ndarray:
    """A 64-bit hash of each span of ``data``."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # stretches that stay in the processor's cache
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + STRETCH_BYTES, "right")))
        lo, hi = starts[a], ends[b - 1]
        size = int(hi - lo)
        up, down = _powers(1 << max(18, size.bit_length()), base)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUES[fold][data[lo:hi]] * up[:size], out=sums[1:])
        begin, end = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        a = b
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each span."""
    return _polynomials(data, starts, ends, fold, _BASE), _polynomials(data, starts, ends, fold, _SECOND_BASE)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of about ``size`` bytes: (row of its first text, bytes, where each text begins and the last one ends).

    Null counts as empty. A text is never split.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_hashes(texts: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of the batch: (row of its first text, hashes of its words, offsets of each text into them)."""
    for row, data, begins in slices(texts, SLICE_BYTES):
        size = len(data)
        if not size:
            yield row, np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
            continue
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = begins[begins < size]
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = cut[cut > 0] - 1
        last[cut] = inside[cut]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield row, _polynomials(data, starts, ends, fold, _BASE), np.searchsorted(starts, begins)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of ``size`` words of a single run of words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out += words[i : len(words) - size + 1 + i] * _STEP[i]
    return mix(out)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; one of the whole sequence where it has fewer words."""
    for _, hashes, before in word_hashes(texts):
        windows = shingle_hashes(hashes, size)
        bounds = before.tolist()
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= size:
                own = np.sort(windows[a : b - size + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif b > a:
                with np.errstate(over="ignore"):
                    yield mix(np.array([(hashes[a:b] * _STEP[8 : 8 + b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
