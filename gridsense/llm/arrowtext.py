"""Vectorised views of Arrow string columns: bytes, words, hashes. No per-character Python.

Words are runs of bytes outside 0x20 and 0x09-0x0D; A-Z are lowered. A word's hash is a
polynomial over randomised byte values modulo 2**64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1_000_000  # bytes of text handled at once; a longer text is handled alone
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
OTHER_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: dict[int, np.ndarray] = {}


def tidy(run: Callable) -> Callable:
    """`run`, a function of batches, giving memory back to the system when a task ends: worker processes are kept and
    may be more than there are cores, so what each holds between tasks counts."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_valid) of a string or binary Arrow array; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid = np.ones(len(column), bool) if not column.null_count else ~np.asarray(column.is_null())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def slices(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] = sum over s <= i < e of BYTE[raw[i]] * BASE**i."""
    h = np.empty(len(raw) + 1, U)
    h[0] = 0
    np.cumsum(BYTE[raw] * powers(BASE, len(raw)), out=h[1:])
    return h


def second_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans by other values of the bytes, so that with `span_hash` 128 bits tell spans apart."""
    h = np.empty(len(raw) + 1, U)
    h[0] = 0
    np.cumsum(OTHER_BYTE[raw] * powers(BASE, len(raw)), out=h[1:])
    return mix((h[end] - h[start]) * powers(INVERSE, len(h))[start] + U(0x94D049BB133111EB))


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), equal for equal bytes wherever they are."""
    inv = powers(INVERSE, len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; offsets are those of the rows in `raw`."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    ink = ~SPACE[raw]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] = ink[edge]
    last[edge - 1] = ink[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every lower-cased word."""
    low = LOWER[raw]
    start, end, row = words(low, offsets)
    return span_hash(prefix_hash(low), start, end), row, start, end


def shingles(hashes: np.ndarray, row: np.ndarray, width: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `width` words of a row; a shorter row with words gives its whole sequence."""
    n = len(hashes)
    acc = hashes.copy()
    m = max(0, n - width + 1)
    out = acc[:m]
    for k in range(1, width):
        out = mix(out * U(0xA24BAED4963EE407) + hashes[k : k + m])
    keep = row[:m] == row[width - 1 :] if m else np.zeros(0, bool)
    counts = np.bincount(row, minlength=rows)
    short = np.flatnonzero((counts > 0) & (counts < width))
    out, at = out[keep], row[:m][keep]
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])[short]
        extra = np.empty(len(short), U)
        for i, (b, c) in enumerate(zip(begin, counts[short], strict=True)):
            h = hashes[b : b + 1]
            for k in range(1, c):
                h = mix(h * U(0xA24BAED4963EE407) + hashes[b + k : b + k + 1])
            extra[i] = mix(h + U(int(c)))[0]
        out, at = np.concatenate([out, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at
