"""Repeated strings of many pieces of text, found by merging Burrows-Wheeler transforms.

Pieces are dealt to shards. Every shard gets its own transform; the transforms are then merged by
refining an interleave of their rows: after t refinements rows are in order of their first t bytes,
and rows that agree in those bytes form an interval. Each refinement steps all rows of an interval
to the rows before them in the text, stably by byte, so no suffix of one shard is ever compared with
one of another. An interval of a single row can't widen again and leaves the interleave; the number
of refinements an interval lasts is the common prefix of its rows.
"""

from __future__ import annotations

import numpy as np

SHARDS = 8
_PACKED = 7  # nine bits a symbol


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and byte before each suffix; 0 ends a piece and is smaller than every byte."""
    n = len(symbols)
    at = np.arange(n)
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, at)] - at  # symbols before the end of the piece
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([symbols, np.zeros(_PACKED, dtype=symbols.dtype)]).astype(np.int64)
    for j in range(_PACKED):
        key = (key << 9) | np.where(left >= j, padded[j : j + n], 0)
    step, longest = _PACKED, int(left.max()) + 1
    # a rank is one more than the row where the suffixes that are equal so far begin; only these are sorted
    # further, by as many ranks as fit in a key, and 0 for what is behind the end of the piece
    bits = n.bit_length()
    order = np.argsort(key)
    rows, key, place = at, key[order], order
    rank = np.zeros(n + 1, dtype=np.int64)
    while True:
        opens = np.ones(len(rows) + 1, dtype=bool)
        np.not_equal(key[1:], key[:-1], out=opens[1:-1])
        heads = np.flatnonzero(opens)
        rank[place] = np.repeat(rows[heads[:-1]] + 1, np.diff(heads))
        equal = ~(opens[:-1] & opens[1:])
        rows, place = rows[equal], place[equal]
        if step >= longest or not len(rows):
            break
        key, behind = rank[place], left[place]
        for j in range(1, 63 // bits):
            key = (key << bits) | rank[np.where(behind >= j * step, place + j * step, n)]
        by = np.argsort(key)
        place, key = place[by], key[by]
        order[rows] = place
        step *= 63 // bits
    # what is equal to the end of its piece is in order of the pieces
    order[rows] = place[np.lexsort((place, rank[place]))]
    before = np.zeros(n, dtype=symbols.dtype)
    before[1:] = symbols[:-1]
    return order, before[order]


def repeated(data: np.ndarray, bounds: np.ndarray, length: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts in data of all strings of so many bytes that occur more than once, and their group numbers.

    bounds: where pieces start, one more at the end; strings don't cross pieces. Rows of a group are
    the occurrences of one string.
    """
    pieces = len(bounds) - 1
    sizes = np.diff(bounds)
    symbols = np.zeros(len(data) + pieces, dtype=np.uint16)
    shift = np.repeat(np.arange(pieces), sizes)
    symbols[np.arange(len(data)) + shift] = data.astype(np.uint16) + 1
    starts = bounds + np.arange(pieces + 1)  # of the pieces among the symbols
    cuts = np.unique(np.searchsorted(starts, np.linspace(0, starts[-1], shards + 1)))
    text_at, symbol_before, last_to_first = [], [], []
    base = 0
    for a, b in zip(starts[cuts[:-1]], starts[cuts[1:]]):
        order, before = transform(symbols[a:b])
        row_of = np.empty(len(order), dtype=np.int64)
        row_of[order] = np.arange(len(order))
        text_at.append(order + a)
        symbol_before.append(before)
        last_to_first.append(row_of[order - 1] + base)
        base += len(order)
    text_at, symbol_before, last_to_first = map(np.concatenate, (text_at, symbol_before, last_to_first))
    last_to_first = last_to_first.astype(np.int32)

    # a repeated string ends at least its length behind the start of its piece
    piece = np.searchsorted(starts, text_at, side="right") - 1
    rows = np.flatnonzero(text_at - starts[piece] >= length).astype(np.int32)
    interval = np.zeros(len(rows), dtype=np.int32)
    # no step goes beyond the start of a piece, so the symbols before are bytes
    before = (symbol_before - 1).astype(np.uint8)
    for _ in range(length):
        symbol = before[rows]
        order = np.argsort(symbol, kind="stable")
        rows, interval, symbol = last_to_first[rows[order]], interval[order], symbol[order]
        first = np.ones(len(rows) + 1, dtype=bool)
        if len(rows):
            first[1:-1] = (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])
        shared = ~(first[:-1] & first[1:])  # not alone in its interval
        rows = rows[shared]
        interval = np.cumsum(first[:-1], dtype=np.int32)[shared]
        if not len(rows):
            break
    found = text_at[rows]
    return found - (np.searchsorted(starts, found, side="right") - 1), interval
