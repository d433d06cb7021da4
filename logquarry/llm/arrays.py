"""Numpy helpers over the bytes of one text: words, hashes of words and of n-grams.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are polynomials
modulo 2**64 taken from prefix sums, so the hash of any slice costs one
subtraction and one product; a last mix spreads the bits. Some long strings
collide in such a polynomial whatever its base, so a slice of more than
``LONG`` bytes is hashed by XXH64 instead.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes up to which a slice of a text is hashed by its polynomial.
LONG = 255
BASE = 0x9E6C63D0876A9A47
BASE_INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: First bytes of code points, that is all but UTF-8 continuation bytes.
IS_POINT = (np.arange(256) & 0xC0) != 0x80

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    """Make the tables of powers at least ``n`` long."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair; equal slices hash alike wherever they stand."""
    n = len(values)
    _grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    hashes = mix((sums[ends] - sums[starts]) * _powers[1][starts] + lengths * np.uint64(0xA24BAED4963EE407))
    if values.dtype == np.uint8:
        view = memoryview(np.ascontiguousarray(values))
        for k in np.flatnonzero(lengths > LONG).tolist():
            hashes[k] = xxhash.xxh64_intdigest(view[starts[k] : ends[k]])
    return hashes


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes ``data``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(count)
    return slice_hashes(words, starts, starts + n)


def recurring(hashes: np.ndarray) -> np.ndarray:
    """Mask of the values that occur at least twice."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    return twice[at] == hashes


def seen_before(hashes: np.ndarray) -> np.ndarray:
    """Mask of the values that occurred earlier in the array."""
    again = np.zeros(len(hashes), bool)
    some = np.flatnonzero(recurring(hashes))
    if len(some):
        order = some[np.argsort(hashes[some], kind="stable")]
        again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
    return again


def covered(marks: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the positions inside windows of ``n`` whose starts are marked."""
    at = np.flatnonzero(marks)
    if not len(at):
        return np.zeros(total, bool)
    steps = np.bincount(at, minlength=total + 1) - np.bincount(at + n, minlength=total + 1)
    return np.cumsum(steps[:total]) > 0
