"""Words, lines and hashes of whole Arrow string columns with numpy.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Hashes are 64-bit polynomial
sums taken from one running total over a chunk of bytes, so that their cost does not
depend on how many words or windows are asked for.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_LOWERED = _VALUES.copy()
_LOWERED[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]


def trim() -> None:
    """Gives freed memory back: an idle Python worker would keep it beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        with np.errstate(over="ignore"):
            _powers = tuple(
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
                for base in (_BASE, _BASE_INVERSE)
            )
    return _powers[0][:n], _powers[1][:n]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of the column; no row is cut."""
    at, n = batch.schema.get_field_index(column), batch.num_rows
    if not n:
        return
    sizes = np.diff(offsets_of(batch.column(at)))
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    yield batch.slice(first, n - first)


def offsets_of(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


@dataclass
class Words:
    """The words of a column: byte spans and hashes, and the first word of each row."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def span(self, row: int) -> slice:
        return slice(int(self.first[row]), int(self.first[row + 1]))


def split_words(column: pa.Array, lower: bool = False, breaks: np.ndarray | None = None) -> Words:
    """Words of a string column; null counts as empty.  ``lower`` folds A-Z; ``breaks`` tells by
    byte what lies between words, white space if not given.

    ``first`` has one more entry than the column has rows.
    """
    if column.null_count:
        column = column.fill_null("")
    rows = offsets_of(column)
    base = int(rows[0]) if len(rows) else 0
    rows = rows - base
    size = int(rows[-1]) if len(rows) else 0
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)
    space = (_SPACE if breaks is None else breaks)[data]
    begin = ~space
    end = np.zeros(size + 1, bool)
    if size:
        edge = np.zeros(size + 1, bool)
        edge[rows] = True
        before = np.concatenate([[True], space[:-1]]) | edge[:-1]
        end[1:] = ~space & (np.concatenate([space[1:], [True]]) | edge[1:])
        begin &= before
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    power, inverse = powers(size + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((_LOWERED if lower else _VALUES)[data] * power[:size], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows), hashes)


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(hashes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=total[1:])
        return mix((total[width:] - total[:-width]) * inverse[:n] + np.uint64(seed + width))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
