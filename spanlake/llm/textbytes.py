"""Vectorised work on the UTF-8 bytes of many texts at once (used inside Arrow tasks).

Texts arrive as Arrow string columns, whose bytes already lie end to end; the
helpers below find words and fingerprints for a whole slice of rows with numpy
instead of looping over rows.  A slice holds about ``SLICE_BYTES`` bytes (more
only if a single text is longer), which bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_WORD = SPACE.copy()  # white space, controls and ASCII punctuation
NO_WORD[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` of a string column (null counts as empty) with their bytes and row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # a column without chunks
        column = pa.array([], pa.string())
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(arr)
    _, off, raw = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer (splitmix64 finaliser) over unsigned 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POW = {"base": np.ones(1, U64), "inv": np.ones(1, U64)}


def powers(n: int, which: str = "base") -> np.ndarray:
    """First ``n`` powers of the fingerprint base (or of its inverse), grown as needed."""
    have = _POW[which]
    if len(have) < n:
        b = BASE if which == "base" else BASE_INV
        have = np.full(max(n, SLICE_BYTES + 1), b, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POW[which] = have if len(have) <= 4 * SLICE_BYTES else _POW[which]
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``P`` with ``span_hash`` of any byte range in constant time (arithmetic modulo 2**64)."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte ranges ``[start, end)``."""
    h = (prefix[ends] - prefix[starts]) * powers(len(prefix), "inv")[starts]
    return mix(h + (ends - starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and row numbers of the words (by default ``[^\\x20\\x09-\\x0D]+``); none crosses a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~between[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], word[:-1])) & ~first[:n]
    after = np.concatenate((word[1:], [False])) & ~first[1:]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``k``-word shingles (repeats kept) in row order, and each row's offsets into them.

    A row with 1 to k-1 words gives its whole word sequence as one shingle; one
    without words gives none.
    """
    count = np.bincount(rows, minlength=n_rows)[:n_rows]
    first = np.concatenate(([0], np.cumsum(count)))
    mult = mix(np.arange(1, k + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    n = len(hashes)
    full = np.zeros(max(0, n - k + 1), U64)
    for j in range(k):
        full += hashes[j:n - k + 1 + j] * mult[j] if len(full) else U64(0)
    same = rows[:n - k + 1] == rows[k - 1:] if len(full) else np.zeros(0, bool)
    out, out_rows = mix(full[same]), rows[:n - k + 1][same] if len(full) else rows[:0]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] += hashes[first[short[has]] + j] * mult[j]
        extra = mix(extra + count[short].astype(U64) * U64(0xD6E8FEB86659FD93))
        out, out_rows = np.concatenate((out, extra)), np.concatenate((out_rows, short))
        order = np.argsort(out_rows, kind="stable")
        out, out_rows = out[order], out_rows[order]
    return out, np.concatenate(([0], np.cumsum(np.bincount(out_rows, minlength=n_rows)[:n_rows])))


def text_shingles(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of the words of a slice, A-Z lower-cased first if asked."""
    if lower:
        data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    return shingles(span_hash(prefix_sums(data), starts, ends), rows, len(offsets) - 1, k)


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``[start, start + length)`` laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out_start = np.cumsum(lengths) - lengths
    return np.repeat(starts - out_start, lengths) + np.arange(total)
