"""Words and word n-grams of whole texts as 64-bit hashes, computed in numpy over the bytes of Arrow batches.

A word is a run of bytes other than space and TAB to CR; A-Z is lower-cased. Equal words always get equal hashes and
unequal ones differ but for a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_random = np.random.default_rng(20240607)
BYTE_CODE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (wrap-around arithmetic)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, extended on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._series(b, max(n, CHUNK_BYTES + 1)) for b in (BASE, BASE_INVERSE))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _series(b: np.uint64, n: int) -> np.ndarray:
        out = np.full(n, b, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_powers = _Powers()


@dataclass
class Words:
    """The words of a few rows: ``first[i]:first[i + 1]`` are the words of row i."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    data: np.ndarray
    row_bytes: np.ndarray  # byte position at which each row begins, and the end
    sums: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def part_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, within words or across them; equal bytes give equal hashes."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * _powers.upto(len(self.data) + 1)[1][start])


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of text, or of one row, so that memory does not grow with the batch."""
    sizes = text_sizes(batch.column(column))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _offsets_and_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None:
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at, raw


def text_sizes(texts: pa.Array) -> np.ndarray:
    return np.diff(_offsets_and_bytes(texts)[0])


def text_bytes(texts: pa.Array, code: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, each replaced by its code, and where each row begins. A NULL text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    at, raw = _offsets_and_bytes(texts)
    return code[raw[at[0] : at[-1]]], at - at[0]


def words(texts: pa.Array, code: np.ndarray = LOWER) -> Words:
    return scan(*text_bytes(texts, code))


def scan(data: np.ndarray, row_bytes: np.ndarray) -> Words:
    inside = ~IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = row_bytes[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, last = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[data] * up[:-1], out=sums[1:])
        hashes = mix((sums[last + 1] - sums[start]) * down[start])
    return Words(hashes, np.searchsorted(start, row_bytes), start, last + 1, data, row_bytes, sums)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every row and the row of each, in text order; fewer words are one shingle."""
    counts = np.diff(w.first)
    total = len(w.hashes)
    with np.errstate(over="ignore"):
        if total >= n:
            rolled = w.hashes[: total - n + 1].copy()
            for k in range(1, n):
                rolled = mix(rolled) + w.hashes[k : total - n + 1 + k]
            rolled = mix(rolled ^ np.uint64(n))
        else:
            rolled = np.zeros(0, dtype=np.uint64)
        row_of = w.row_of
        whole = row_of[: len(rolled)] == row_of[n - 1 :] if total >= n else np.zeros(0, dtype=bool)
        out, rows = rolled[whole], row_of[: len(rolled)][whole]
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            extra = []
            for r in short:
                h = w.hashes[w.first[r] : w.first[r] + 1]
                for k in range(1, counts[r]):
                    h = mix(h) + w.hashes[w.first[r] + k : w.first[r] + k + 1]
                extra.append(mix(h ^ np.uint64(int(counts[r])))[0])
            out, rows = np.concatenate([out, np.array(extra, dtype=np.uint64)]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            out, rows = out[order], rows[order]
    return out, rows


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, sorted, one after the other, and the bounds of the rows."""
    hashes, rows = ngrams(w, n)
    bounds = np.searchsorted(rows, np.arange(w.rows + 1))
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.concatenate(parts) if parts else hashes), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(np.uint64, copy=False).view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))


def each_chunk(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from chunks(batch, column, most)
    # the worker may wait for its next task, or begin one of another operator
    batch = None
    pa.default_memory_pool().release_unused()
