"""Benchmark decontamination: word n-grams of the test items find passages, local alignment scores them.

The items are taken in blocks of bounded size, each against all documents. All n-grams of an item are its seeds, however
common they are, so that what is found in a document does not depend on the others. An item is aligned with the passages
where its seeds occur, unless too few of its words are there for the least score. Documents are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.llm import align, text

SEED_WORDS = 3
BLOCK_BYTES = 4 << 20
SHORT_ITEM = 8
RESULT = "doc_id long, item_id long, score double, matched_words int, item_words int, start_word long, end_word long"

PLAIN = text.LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


@dataclass
class Block:
    """Items as word hashes, and their seeds: sorted hashes, each with (item, place) pairs."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    places: list[list[tuple[int, int]]]

    def filter(self) -> np.ndarray:
        bits = np.zeros(1 << 22, dtype=bool)
        bits[(self.seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return bits


def _block(ids: list[int], words: list[np.ndarray], grams: dict[int, list[tuple[int, int]]]) -> Block:
    seeds = np.array(sorted(grams), dtype=np.uint64)
    return Block(ids, words, seeds, [grams[int(s)] for s in seeds])


def item_block(rows: list[tuple[int, str]]) -> Block:
    w = text.words(pa.array([t for _, t in rows], pa.string()), PLAIN)
    grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
    hashes, row = text.ngrams(w, SEED_WORDS)
    first = np.searchsorted(row, np.arange(len(rows)))
    for k, (h, r) in enumerate(zip(hashes.tolist(), row.tolist())):
        grams[h].append((r, k - int(first[r])))
    return _block([i for i, _ in rows], [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:])], grams)


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """All items in blocks of at most ``BLOCK_BYTES`` of text or one item, in order of their ids."""
    held, size = [], 0
    for r in items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].encode())
        if held and size + n > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield held


def _hits(w: text.Words, seeds: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word place in the row, seed) of every seed in these texts."""
    hashes, row = text.ngrams(w, SEED_WORDS)
    maybe = np.flatnonzero(bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)])
    at = np.searchsorted(seeds, hashes[maybe])
    sure = (at < len(seeds)) & (seeds[np.minimum(at, len(seeds) - 1)] == hashes[maybe])
    maybe, at = maybe[sure], at[sure]
    first = np.searchsorted(row, np.arange(w.rows))
    return row[maybe], maybe - first[row[maybe]], at


def _enough(item: np.ndarray, passage: np.ndarray, reach: int, least: float) -> bool:
    """Whether a part of ``reach`` words can match ``least`` of the item's words, by counts of common words."""
    wanted = least * len(item) - 1e-9
    words = np.unique(item)
    common = words[np.minimum(np.searchsorted(words, passage), len(words) - 1)] == passage
    if common.sum() < wanted or np.isin(item, passage[common]).sum() < wanted:
        return False
    upto = np.concatenate([[0], np.cumsum(common)])
    return bool((upto[reach:] - upto[:-reach]).max() >= wanted) if len(passage) > reach else True


def _best(doc: np.ndarray, item: np.ndarray, places: list[int], least: float) -> align.Alignment:
    """The best alignment of an item with the passages around these places of the document, if it has the least score.

    With a score of ``least`` or more, an alignment has at most 2 (1 - least) of the item's length in gaps.
    """
    n, best, k = len(item), align.NONE, 0
    reach = n + int(align.MATCH * n * (1 - least)) + 1
    places.sort()
    while k < len(places) and best.score < align.MATCH * n:
        last = k
        while last + 1 < len(places) and places[last + 1] - places[last] <= reach and places[last + 1] - places[k] <= 3 * n:
            last += 1
        low, high = max(0, places[k] - reach), places[last] + reach + SEED_WORDS
        if _enough(item, doc[low:high], reach, least):
            found = align.smith_waterman(item, doc[low:high])
            if found.score > best.score:
                best = align.Alignment(found.score, found.matched, found.a_start, found.a_end, found.b_start + low, found.b_end + low)
        k = last + 1
    return best


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document and item whose alignment score is at least ``least`` of that of an exact copy (all of it for an
    item of fewer than 8 words): doc_id, item_id, score, matched_words, item_words, start_word, end_word. The two have
    three consecutive words in common; without these nothing is aligned.

    Words are runs of letters and digits, lower-cased. NULL or empty texts and items, and items without a word, match
    nothing. Ids may repeat: each row of either side is matched by itself. A NULL doc_id is kept as such. Other columns are
    not read. Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for some in blocks(items):
        block = item_block(some)
        if not len(block.seeds):
            continue
        found = rows.mapInArrow(_aligner(block, spark, least), RESULT)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT) if out is None else out


def _aligner(block: Block, spark: SparkSession, least: float):
    shared = spark.sparkContext.broadcast((block, block.filter()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bits = shared.value
        for batch in text.each_chunk(batches):
            w = text.words(batch.column("text"), PLAIN)
            met: dict[tuple[int, int], list[int]] = defaultdict(list)
            for row, place, seed in zip(*(x.tolist() for x in _hits(w, block.seeds, bits))):
                for item, _ in block.places[seed]:
                    met[row, item].append(place)
            out = []
            for (row, item), places in met.items():
                words = block.words[item]
                wanted = least if len(words) >= SHORT_ITEM else 1.0
                best = _best(w.hashes[w.first[row] : w.first[row + 1]], words, places, wanted)
                score = best.score / (align.MATCH * len(words))
                if score >= wanted:
                    out.append((batch.column("doc_id")[row].as_py(), block.ids[item], score, best.matched, len(words), best.b_start, best.b_end))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return run


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those that hold a passage of an item. Each row is judged by its own text, whatever its id: rows are known by a
    64-bit hash of the text."""
    from drayline.session import workspace

    path = workspace(spark, "contaminated")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.xxhash64(body).alias("doc_id"), "text")
    contaminated(spark, hashed, items, least).select("doc_id").distinct().write.parquet(path)
    found, row, h = spark.read.parquet(path).select(F.col("doc_id").alias("found")), "row", F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    return docs.select(F.struct(*docs.columns).alias(row)).join(found, h == F.col("found"), "left_anti").select("row.*")
