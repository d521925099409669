"""Sets of hashed word shingles of whole texts, in numpy over Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from relief.llm.common import mix64, text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: words are runs of other bytes than space and 0x09-0x0D
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
#: a 64-bit value per byte, a multiplier for positions in a word and one for positions in a shingle
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE = np.where(_WORD, _BYTE[_LOWER], np.uint64(0))
_STEP, _NEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_MASK = (1 << 64) - 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every lower-cased (A-Z) word of every row, and the words' offsets by row."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    word = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word never spans two rows
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    which = np.cumsum(start) - 1
    place = np.arange(len(data)) - starts[np.maximum(which, 0)]
    place[~word] = 0
    power = np.full(int(place.max()) + 1, _STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.add.reduceat(_BYTE[data] * power[place], starts)
    lengths = np.add.reduceat(word.astype(np.int64), starts).astype(np.uint64)
    return mix64(sums + lengths * _NEXT), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingle hashes of every row, ascending, back to back, and their offsets by row.

    A row of fewer words has one shingle, its whole sequence; a row without words (or null) has none.
    """
    hashes, at = words(column)
    count = np.diff(at)
    row = np.repeat(np.arange(len(count)), count)
    if not len(hashes):
        return hashes, np.zeros(len(count) + 1, np.int64)
    n = len(hashes) - size + 1
    full, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total = total * _NEXT + hashes[j : j + n]
        same = row[:n] == row[size - 1 :]
        full, of = mix64(total[same]), row[:n][same]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = []
        for r in short:
            total = int(count[r])
            for h in hashes[at[r] : at[r + 1]].tolist():
                total = (total * int(_STEP) + h) & _MASK
            whole.append(total)
        full, of = np.r_[full, mix64(np.array(whole, np.uint64))], np.r_[of, short]
        order = np.argsort(of, kind="stable")
        full, of = full[order], of[order]
    ends = np.searchsorted(of, np.arange(len(count) + 1)).tolist()
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        full[lo:hi].sort()  # row by row: much faster than one sort by row and hash
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (of[1:] != of[:-1])
    return full[new], np.searchsorted(of[new], np.arange(len(count) + 1))
