"""Local sequence alignment in numpy, whole or in a band around a diagonal; linear gap costs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Alignment:
    score: int
    matched: int  # equal positions
    a_start: int
    a_end: int
    b_start: int
    b_end: int


NONE = Alignment(0, 0, 0, 0, 0, 0)


def _walk(table: np.ndarray, a: np.ndarray, b: np.ndarray, i: int, j: int, column) -> Alignment:
    """Back from the cell after a[:i], b[:j]; ``column`` maps (i, j) to the table's column."""
    score, a_end, b_end, matched = int(table[i, column(i, j)]), i, j, 0
    width = table.shape[1]

    def at(x: int, y: int) -> int:
        c = column(x, y)
        return int(table[x, c]) if x >= 0 and y >= 0 and 0 <= c < width else -(1 << 30)

    while at(i, j) > 0:
        here = at(i, j)
        same = i > 0 and j > 0 and a[i - 1] == b[j - 1]
        if i > 0 and j > 0 and here == at(i - 1, j - 1) + (MATCH if same else MISMATCH):
            matched += same
            i, j = i - 1, j - 1
        elif i > 0 and here == at(i - 1, j) + GAP:
            i -= 1
        elif j > 0 and here == at(i, j - 1) + GAP:
            j -= 1
        else:  # an alignment that begins here with a matching pair outside the band
            break
    return Alignment(score, int(matched), i, a_end, j, b_end)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> Alignment:
    """The best local alignment of two sequences of numbers."""
    if not len(a) or not len(b):
        return NONE
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    ramp = -GAP * np.arange(len(b) + 1, dtype=np.int32)
    for i in range(1, len(a) + 1):
        above, row = table[i - 1], table[i]
        np.maximum(above[:-1] + np.where(b == a[i - 1], MATCH, MISMATCH), above[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        np.maximum(np.maximum.accumulate(row + ramp) - ramp, 0, out=row)
    i, j = np.unravel_index(int(np.argmax(table)), table.shape)
    return _walk(table, a, b, int(i), int(j), lambda x, y: y)


def banded(a: np.ndarray, b: np.ndarray, diagonal: int, band: int) -> Alignment:
    """The best local alignment whose cells (i, j) keep ``abs(j - i - diagonal) <= band``."""
    if not len(a) or not len(b):
        return NONE
    width = 2 * band + 1
    table = np.zeros((len(a) + 1, width), dtype=np.int32)
    ramp = -GAP * np.arange(width, dtype=np.int32)
    padded = np.full(len(a) + len(b) + 2 * width + abs(diagonal) + 2, -1, dtype=np.int64)
    shift = width + max(0, -diagonal) + band + 1
    padded[shift : shift + len(b)] = b
    for i in range(1, len(a) + 1):
        first = i + diagonal - band  # j of column 0
        seen = padded[shift + first - 1 : shift + first - 1 + width]
        above, row = table[i - 1], table[i]
        row[:] = above + np.where(seen == a[i - 1], MATCH, MISMATCH)
        row[:-1] = np.maximum(row[:-1], above[1:] + GAP)
        j = np.arange(first, first + width)
        inside = (j >= 1) & (j <= len(b))
        row[~inside] = 0
        np.maximum(row, 0, out=row)
        np.maximum(np.maximum.accumulate(row + ramp) - ramp, 0, out=row)
        row[~inside] = 0
    i, c = np.unravel_index(int(np.argmax(table)), table.shape)
    return _walk(table, a, b, int(i), int(i) + diagonal - band + int(c), lambda x, y: y - (x + diagonal - band))
