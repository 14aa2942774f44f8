"""Texts of an Arrow batch as bytes, and hashes of their words, with whole-array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import at_task_end

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_P), -1, 1 << 64))
_powers = np.ones(1, _U), np.ones(1, _U)


@at_task_end
def _forget() -> None:
    global _powers
    _powers = np.ones(1, _U), np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, at least ``n``; kept for the task."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        made = []
        for base in (_P, _INVERSE):
            a = np.full(size, base, _U)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        if size > 1 << 20:  # only a long text: do not keep these
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``most`` bytes; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] a hash of data[i:j], up to the factor of position i."""
    p, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * p[: len(data)], out=s[1:])
    return s


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    if fold_case:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.ones(len(data) + 1, bool)  # a text starts here, or all ends
    first[:-1] = False
    first[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | first[:-1]
    after = np.concatenate([space[1:], [True]]) | first[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    with np.errstate(over="ignore"):
        s = prefix_sums(data)
        _, inverse = powers(len(data) + 1)
        words = mix((s[ends] - s[starts]) * inverse[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    return words, np.searchsorted(starts, offsets, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, fold_case: bool = True) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct hashes of ``size``-word shingles; fewer words make one shingle, none an empty set."""
    words, first = word_hashes(data, offsets, fold_case)
    with np.errstate(over="ignore"):
        salt = _U(0x2545F4914F6CDD1D)
        h = words
        for j in range(1, size):
            h = mix(h[:-1] * salt + words[j:]) if len(h) > 1 else h[:0]
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= size:
                yield np.unique(h[lo : hi - size + 1])
            elif hi > lo:
                x = words[lo : lo + 1]
                for j in range(lo + 1, hi):
                    x = mix(x * salt + words[j : j + 1])
                yield mix(x + _U(hi - lo))
            else:
                yield h[:0]
