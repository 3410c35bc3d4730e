"""License scan: winnowed fingerprints of license notices find candidates, banded alignment measures them.

A text is reduced to lower-case letters and digits with single spaces. Of the hashes of its k-byte substrings every window
of w keeps the least; texts that share k + w - 1 bytes share such a fingerprint. Fingerprints of the notices form an
inverted index of fixed size that every task holds. Beside short notices it holds standard headers and whole texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.llm import align, text
from drayline.llm.decontamination import PLAIN
from drayline.llm.license_texts import TEXTS

GRAM, WINDOW, BAND = 12, 8, 16
#: A template of more bytes has a wider band, in which this share of its fingerprints must be met.
LONG, WIDEST, LEAST_MET = 400, 64, 0.05
RESULT = "doc_id long, license string, coverage double, start long, end long"

#: Common license notices by their public identifiers.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
} | TEXTS


def reduced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with single spaces, where each row begins among them, and the place of each in the original bytes."""
    data, row_bytes = text.text_bytes(texts, PLAIN)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    starts = row_bytes[:-1][row_bytes[:-1] < len(data)]
    keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[row_bytes], np.flatnonzero(keep)


def grams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-byte substrings that stay in one row, and their places."""
    scanned = text.scan(data, rows)
    place = np.arange(max(0, len(data) - GRAM + 1))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    whole = row[: len(place)] == row[GRAM - 1 :][: len(place)]
    place = place[whole]
    return scanned.part_hashes(place, place + GRAM), place


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash of every window (the last of equal ones); of all, where there are fewer than a window."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, min(WINDOW, len(hashes)))[:, ::-1]
    return np.unique(np.arange(len(view)) + view.shape[1] - 1 - np.argmin(view, axis=1))


class Index:
    def __init__(self, notices: dict[str, str]) -> None:
        self.names = sorted(notices)
        self.bytes: list[np.ndarray] = []
        self.marks: list[int] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, name in enumerate(self.names):
            data, rows, _ = reduced(pa.array([notices[name].strip()]))
            if len(data) and data[-1] == 32:
                data, rows = data[:-1], rows - [0, 1]
            self.bytes.append(data.astype(np.int64))
            hashes, place = grams(data, rows)
            least = winnow(hashes)
            self.marks.append(len(least))
            for at in least:
                self.places[int(hashes[at])].append((k, int(place[at])))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[[h & ((1 << 20) - 1) for h in self.places]] = True


def _candidates(index: Index, data: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], Counter[int]]:
    """Diagonals by (row, notice), and how often: where a winnowed fingerprint of the row is one of the notice."""
    hashes, place = grams(data, rows)
    row = np.searchsorted(rows, place, "right") - 1
    first = np.searchsorted(row, np.arange(len(rows)))
    met: dict[tuple[int, int], Counter[int]] = defaultdict(Counter)
    for k in np.flatnonzero(index.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]):
        notices = index.places.get(int(hashes[k]))
        if notices:
            low, high = max(first[row[k]], k - WINDOW + 1), min(first[row[k] + 1], k + WINDOW)
            if (k - low) in winnow(hashes[low:high]):
                for notice, at in notices:
                    met[int(row[k]), notice][int(place[k] - rows[row[k]]) - at] += 1
    return met


def _bands(diagonals: Counter[int], size: int, marks: int) -> tuple[list[int], int]:
    """Diagonals to align along, and the width of the band to each side.

    A long template is aligned only where a band meets enough of its fingerprints, once for diagonals near each other.
    """
    if size <= LONG:
        return sorted(diagonals), BAND
    band = min(WIDEST, max(BAND, size // 16))
    places = np.array(sorted(diagonals))
    upto = np.concatenate([[0], np.cumsum([diagonals[d] for d in places.tolist()])])
    met = upto[np.searchsorted(places, places + band, "right")] - upto[np.searchsorted(places, places - band)]
    out: list[int] = []
    for k in np.argsort(-met, kind="stable"):
        if met[k] < LEAST_MET * marks:
            break
        if all(abs(int(places[k]) - d) > band // 2 for d in out):
            out.append(int(places[k]))
    return out, band


def scan(docs: DataFrame, notices: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, coverage (share of the notice's characters matched) and the span in code points, end exclusive.

    One row per document and place where at least ``least`` of a notice is matched; of matches that overlap the one with
    the higher alignment score (then the higher coverage, then the first name). Of templates beyond ``LONG`` bytes a place
    must share ``LEAST_MET`` of the fingerprints. NULL, empty and short texts
    match nothing. A NULL doc_id is kept as such; repeated rows are scanned each by itself. Other columns are not read. An
    empty table, or no notices, gives no rows.
    """
    index = Index(NOTICES if notices is None else notices)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in text.each_chunk(batches):
            data, rows, original = reduced(batch.column("text"))
            raw_rows = np.concatenate([[0], np.cumsum(text.text_sizes(batch.column("text").fill_null("")))])
            met: dict[int, list[tuple[int, float, int, int, int]]] = defaultdict(list)
            for (row, notice), diagonals in _candidates(index, data, rows).items():
                wanted, base = index.bytes[notice], int(rows[row])
                if rows[row + 1] - base < least * len(wanted):
                    continue
                along, band = _bands(diagonals, len(wanted), index.marks[notice])
                for diagonal in along:
                    low, high = max(0, diagonal - band), diagonal + len(wanted) + band
                    part = data[base + low : min(base + high, int(rows[row + 1]))].astype(np.int64)
                    found = align.banded(wanted, part, diagonal - low, band)
                    coverage = found.matched / len(wanted)
                    if coverage >= least:
                        met[row].append((found.score, coverage, notice, base + low + found.b_start, base + low + found.b_end))
            out = []
            for row, matches in sorted(met.items()):
                whole, kept = (batch.column("text")[row].as_py() or "").encode(), []
                for match in sorted(matches, key=lambda m: (-m[0], -m[1], m[2:])):
                    if all(match[4] <= other[3] or other[4] <= match[3] for other in kept):
                        kept.append(match)
                for _, coverage, notice, start, end in sorted(kept, key=lambda m: m[3]):
                    place = [int(original[at]) - int(raw_rows[row]) for at in (start, end - 1)]
                    span = len(whole[: place[0]].decode(errors="ignore")), len(whole[: place[1] + 1].decode(errors="ignore"))
                    out.append((batch.column("doc_id")[row].as_py(), index.names[notice], coverage, *span))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in RESULT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, RESULT)
