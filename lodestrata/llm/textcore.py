"""Vectorised text work on Arrow string columns: byte slices, tokens and their 64-bit hashes.

Everything here runs inside tasks on one slice of a record batch at a time, so memory stays a small multiple of SLICE_BYTES
(or of the longest single text, if that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lut(predicate) -> np.ndarray:
    return np.array([predicate(b) for b in range(256)])


#: Bytes that are not ASCII white space (tab to carriage return, and blank).
NOT_SPACE = _lut(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ASCII digits and lower-case letters, and every byte of a character beyond ASCII; capitals count as they are folded.
ALNUM = _lut(lambda b: b >= 0x80 or chr(b).isalnum())
#: A-Z to a-z; other bytes stay.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_ROOT)) | _U(1)


class _Powers:
    """Powers of the hash's base and of its inverse, as far as any slice has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=_U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, SLICE_BYTES)
            steps = np.full(n, _ROOT, dtype=_U)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps = np.full(n, _ROOT_INVERSE, dtype=_U)
            steps[0] = 1
            self.down = np.cumprod(steps)
        return self.up, self.down


_POWERS = _Powers()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): whole texts, up to limit bytes together, or one longer text alone."""
    data, at = column_bytes(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        high = min(high, n)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def token_bounds(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, which no text's border lets through, and the first token of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = words[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def released(run: Callable) -> Callable:
    """A function for mapInArrow after which the worker, which waits for further tasks, gives the system back what Arrow and numpy have freed."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidy


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class SpanHashes:
    """64-bit hashes of stretches of some bytes, alike wherever they stand."""

    def __init__(self, data: np.ndarray, fold: bool = True) -> None:
        up, self.down = _POWERS.of(len(data) + 1)
        values = _VALUES[FOLD] if fold else _VALUES
        self.sums = np.empty(len(data) + 1, dtype=_U)
        self.sums[0] = 0
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    return SpanHashes(data, fold)(starts, ends) if len(starts) else np.zeros(0, _U)


def chain(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """One hash for each position i of the items at i + offsets (ascending from 0), as far as the last is there."""
    n = max(0, len(hashes) - offsets[-1])
    out = np.full(n, len(offsets), dtype=_U)
    for k in offsets:
        out = mix(out * _U(0xD6E8FEB86659FD93) + hashes[k : k + n])
    return out


def window_rows(firsts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions at which a window of span tokens fits into its row, and those rows."""
    counts = np.diff(firsts)
    room = np.maximum(counts - span + 1, 0)
    rows = np.repeat(np.arange(len(counts)), room)
    before = np.repeat(firsts[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room)
    return np.arange(len(rows)) + before, rows


def rolling(hashes: np.ndarray, span: int) -> np.ndarray:
    """One hash for each run of span consecutive items, in a time that doesn't depend on span."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = _POWERS.of(len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, dtype=_U)
    sums[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[span:] - sums[:n]) * down[:n] + _U(span))


def folded_words(data: np.ndarray, words: np.ndarray) -> list[bytes]:
    """The words of some bytes, A-Z lower-cased."""
    return [w for w in np.where(words[data], FOLD[data], np.uint8(0x20)).tobytes().split(b" ") if w]


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order; sorting is much faster here than numpy's hash table."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
