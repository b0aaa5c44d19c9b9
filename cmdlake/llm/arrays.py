"""Texts of an Arrow batch as flat NumPy arrays, and hashes of their words computed without a loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about most bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(max(n, SLICE + (SLICE >> 1)), base, np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of bytes i to j, times base^i."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_SYMBOLS[data] * powers(len(data))[0], out=out[1:])
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word of rows that hold at least a byte."""
    n, space = len(data), _SPACE[data]
    start = ~space
    start[1:] &= space[:-1] | False
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = ~space[inner]
    end = ~space
    end[:-1] &= space[1:]
    end[inner - 1] = ~space[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


_PIECE = np.uint64(0xA0761D6478BD642F)
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
FEW = 8


def _piece(view: np.ndarray, at: np.ndarray, left: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """The scrambled eight bytes from at, of which left count, as the k-th of their word."""
    with np.errstate(over="ignore"):
        return mix((view[at] & _KEPT[np.minimum(left, 8)]) + (np.asarray(k).astype(np.uint64) + np.uint64(1)) * _PIECE)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words in each row): words are runs without white space, A-Z taken as a-z.

    A word is summed over its pieces of eight bytes, each scrambled with its place, so that no
    arrangement of bytes cancels out as it may in a polynomial modulo 2^64.
    """
    if lower:
        data = _LOWER[data]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    s, e = word_bounds(data, offsets)
    size = e - s
    view = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = _piece(view, s, size, 0)
    with np.errstate(over="ignore"):
        for k in range(1, FEW):
            some = np.flatnonzero(size > 8 * k)
            if not len(some):
                break
            h[some] += _piece(view, s[some] + 8 * k, size[some] - 8 * k, k)
        some = np.flatnonzero(size > 8 * FEW)
        if len(some):
            more = (size[some] + 7) // 8 - FEW
            first = np.cumsum(more) - more
            k = np.arange(more.sum()) - np.repeat(first, more) + FEW
            h[some] += np.add.reduceat(_piece(view, np.repeat(s[some], more) + 8 * k, np.repeat(size[some], more) - 8 * k, k), first)
        values = mix(h + size.astype(np.uint64))
    counts = np.searchsorted(s, offsets[1:]) - np.searchsorted(s, offsets[:-1])
    return values, counts


def by_row(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by row, then value."""
    if len(row) and row.max() < 1 << 16:  # two sorts, the second by counting
        order = np.argsort(values)
        return order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    return np.lexsort((values, row))


_PLACES = mix(np.arange(101, 106, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, by row then hash.

    A shingle is size words in a row; fewer words make one shingle of all; no words make none.
    """
    w, counts = words(data, offsets)
    rows, first = len(counts), np.concatenate([[0], np.cumsum(counts)])
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(rows), per)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    left = counts[row]
    out = np.zeros(len(row), np.uint64)
    padded = np.concatenate([w, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(size):
            # a missing word adds nothing; the number of words sets short rows apart
            out += np.where(left > k, padded[at + k] * _PLACES[k % 5], np.uint64(0))
        out = mix(out + np.minimum(left, size).astype(np.uint64))
    order = by_row(row, out)
    row, out = row[order], out[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    return row[keep], out[keep]


def whole_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, run bounds) from sorted batches, so that every run of equal values of by is in one piece."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for name in by:
            x = batch.column(name).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(new)])
        held = batch.slice(int(bounds[-1]))
        if len(bounds) > 1:
            yield batch.slice(0, int(bounds[-1])), bounds
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])
