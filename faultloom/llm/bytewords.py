"""Words of many texts at once: numpy over the bytes of an Arrow string column.

A text is its UTF-8 bytes, a word is a maximal run of bytes that a 256-entry table accepts, and
words never cross texts. Words and word sequences are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: texts taken together: their arrays stay in a core's cache
BLOCK_BYTES = 1 << 18
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_ALL = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def keep_memory() -> None:
    """Let this process keep the memory of freed arrays for the next ones.

    The C library hands every array over a threshold back to the system, and its pages are made anew for the
    next one, which takes longer than the arithmetic on them; the threshold grows to the largest array freed.
    """
    np.empty(1 << 24, dtype=np.uint8)


def byte_table(accepted) -> np.ndarray:
    """Which byte values belong to words."""
    table = np.zeros(256, dtype=bool)
    table[list(accepted)] = True
    return table


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n at least."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, BLOCK_BYTES + 4096), base, dtype=np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        _powers[base] = found
    return found


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _P) -> np.ndarray:
    """Hash of values[start:end] for every pair of bounds, by one running sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(base, n + 1)[:n], out=total[1:])
    back = _power(pow(base, -1, 1 << 64), n + 1)
    out = (total[end] - total[start]) * back[start]
    return mix(out ^ ((end - start).astype(np.uint64) * np.uint64(_Q)))


def window_hashes(values: np.ndarray, length: int, base: int = _P) -> np.ndarray:
    """range_hashes of all runs of so many neighbouring values."""
    n = len(values)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    powered = values.astype(np.uint64)
    powered += np.uint64(1)
    powered *= _power(base, n + 1)[:n]
    np.cumsum(powered, out=total[1:])
    out = total[length:] - total[:-length]
    out *= _power(pow(base, -1, 1 << 64), n + 1)[: n - length + 1]
    out ^= np.uint64(length * _Q & _ALL)
    return mix(out)


def sequence_hashes(word_hash: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of so many neighbouring words, texts not regarded."""
    start = np.arange(max(0, len(word_hash) - length + 1))
    return range_hashes(word_hash, start, start + length, _Q)


class Block:
    """Some neighbouring texts: rows first..last of their batch, bytes and bounds."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, and for each text its first word (one more at the end)."""
        inside = np.zeros(len(self.data) + 1, dtype=bool)
        np.take(table, self.data, out=inside[:-1])
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = self.bounds[:-1]
        begins[cut] = inside[cut]
        edge = cut[cut > 0] - 1
        ends[edge] = inside[edge]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, self.bounds)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return range_hashes(self.data, start, end)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column, nulls as empty texts, without a copy where there is none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not wide and not (pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    parts = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(parts[1], dtype=np.int64 if wide else np.int32)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], dtype=np.uint8) if parts[2] else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(texts: pa.Array, lower: bool = True, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts in pieces of at most limit bytes, or one text where that is longer."""
    data, bounds = buffers(texts)
    n, first = len(bounds) - 1, 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        piece = data[bounds[first] : bounds[last]]
        yield Block(first, LOWER[piece] if lower else piece, bounds[first : last + 1] - bounds[first])
        first = last
