"""Vectorised text handling on the UTF-8 bytes of an Arrow string column.

A batch of texts is one byte array plus offsets.  Words are maximal runs of bytes of one class inside a text; they are
hashed with a polynomial over prefix sums and a 64-bit finaliser, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 18  # bytes hashed at once
_BLOCK = 1 << 20  # bytes of text handled at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words that white space ends: the bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Words of letters and digits: the bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lowered.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = _BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``size`` bytes of text (a longer text is a run of its own)."""
    data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    low, n = 0, batch.num_rows
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | new[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | new[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _STEP), _powers(_INVERSE, _STEP)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes give equal hashes in every batch and process."""
    out = np.empty(len(starts), U64)
    low = 0
    while low < len(starts):
        at = starts[low]
        high = int(np.searchsorted(ends, at + _STEP, "right"))
        if high <= low:  # a word longer than a step
            h, up = 0, 1
            for k in range(at, ends[low], _STEP):
                part = data[k : min(k + _STEP, ends[low])].astype(U64) + U64(1)
                h = (h + int((part * _UP[: len(part)]).sum(dtype=U64)) * up) & _MASK
                up = up * pow(_BASE, _STEP, 1 << 64) & _MASK
            out[low] = h
            low += 1
            continue
        s, e = starts[low:high] - at, ends[low:high] - at
        size = int(e[-1])
        total = np.zeros(size + 1, U64)
        part = data[at : at + size].astype(U64)
        part += U64(1)
        part *= _UP[:size]
        np.cumsum(part, out=total[1:])
        out[low:high] = (total[e] - total[s]) * _DOWN[s]
        low = high
    return mix(out)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return LOWER[data]


def crc32_mod(ids, m: int) -> np.ndarray:
    """crc32 of each id as text, modulo m."""
    import zlib

    return np.array([zlib.crc32(str(x).encode()) % m if x is not None else 0 for x in ids], np.int64)
