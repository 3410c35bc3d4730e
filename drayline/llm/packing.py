"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Documents are tokenized where they lie and cut only when longer than the capacity. What the packing depends on is the
number of pieces of each length, at most ``capacity`` numbers whatever the corpus holds, so the plan is made for the
whole corpus from that histogram: pieces above a third of the capacity pair at most twice in a sequence, by greedy
matching from the longest down (each takes the longest partner that fits, which opens the fewest sequences); shorter
ones go, longest first, to the smallest gap that holds them. The plan is a list of intervals: the pieces numbered
lo..hi of a length go to consecutive sequences at one offset. Pieces are numbered within their length by Spark, over
buckets of documents, so that no length is handled by a single task.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drayline.llm import text as texts_of
from drayline.llm.bpe import MergeTable
from drayline.session import workspace

TOGETHER_BYTES = 1 << 22
LONGEST = 48
MERGED = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END_ID = 1

KEPT = np.arange(256, dtype=np.uint8)
#: Line ends and TAB cut words as a space does.
SPACES = KEPT.copy()
SPACES[[9, 10, 13]] = 32
#: What a byte of a word is. An apostrophe may begin a contraction and a < a special token, so the library tokenizes such words.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KINDS = np.full(256, OTHER, dtype=np.uint8)
KINDS[33:127] = SIGN
KINDS[[ord(c) for c in "'<"]] = OTHER
KINDS[65:91] = KINDS[97:123] = LETTER
KINDS[32] = SPACE
KINDS[48:58] = DIGIT


def _latin_lower() -> np.ndarray:
    """The lower-case form of letters below U+0250 beyond ASCII that is one such letter too, else 0."""
    lower = [c.lower() if (c := chr(i)).isalpha() else "" for i in range(0x80, 0x250)]
    kept = [ord(c) if len(c) == 1 and 0x80 <= ord(c) < 0x250 and unicodedata.normalize("NFC", c) == c else 0 for c in lower]
    return np.array([0] * 0x80 + kept + [0] * (0x800 - 0x250))


LATIN_LOWER = _latin_lower()


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.BinaryArray:
    """Values that lie one behind the other; the data is not copied."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


@dataclass
class Ids:
    """Lists of token ids, or of bytes: list i is ``flat[first[i] : first[i] + counts[i]]``."""

    flat: np.ndarray
    first: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, lists: list[bytes]) -> Ids:
        counts = np.array([len(x) // 4 for x in lists], dtype=np.int64)
        return cls(np.frombuffer(b"".join(lists), dtype="<u4"), _bounds(counts)[:-1], counts)

    def joined(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chosen lists one behind the other, and the bounds of each."""
        counts = self.counts[chosen]
        bounds = _bounds(counts)
        return self.flat[np.repeat(self.first[chosen] - bounds[:-1], counts) + np.arange(bounds[-1])], bounds


class WordTokenizer:
    """Token ids of many words together.

    A run of Latin letters, a digit, and a run of ASCII signs are a piece each, and normalisation only lower-cases them; the distinct
    pieces of such words are merged many at a time. The library tokenizes the other words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"])

    def _ids(self, words: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 10_000):
            some = [w.decode() for w in words[at : at + 10_000]]
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def pieces(self, pieces: pa.BinaryArray) -> Ids:
        """Ids of distinct pieces; a space has none."""
        data, bounds = texts_of.text_bytes(pieces, KEPT)
        sizes = np.diff(bounds)
        order = np.argsort(sizes, kind="stable")
        short, long = np.split(order, [np.searchsorted(sizes[order], LONGEST, "right")])
        flat, first, counts, many = [], np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64), 0
        for some in (short[at : at + MERGED] for at in range(0, len(short), MERGED)):
            ids, counts[some] = self.merges.merge(Ids(data, bounds[:-1], sizes).joined(some)[0], sizes[some])
            first[some] = many + _bounds(counts[some])[:-1]
            flat.append(ids.view("<u4"))
            many += len(ids)
        others = Ids.of(self._ids(pieces.take(pa.array(long)).to_pylist()))
        first[long], counts[long] = many + others.first, others.counts
        counts[(sizes == 1) & (data[np.minimum(bounds[:-1], max(0, len(data) - 1))] == 32)] = 0
        return Ids(np.concatenate([*flat, others.flat]), first, counts)

    def words(self, words: pa.BinaryArray) -> Ids:
        """Ids of words, each of which may begin with a space."""
        data, row_bytes = texts_of.text_bytes(words, KEPT)
        kinds = KINDS[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        lead = lead[lead + 1 < len(data)]
        lower = LATIN_LOWER[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
        lead, lower = lead[lower > 0], lower[lower > 0]
        data[lead], data[lead + 1] = 0xC0 | lower >> 6, 0x80 | lower & 63
        kinds[lead] = kinds[lead + 1] = LETTER
        strange = np.diff(_bounds(kinds == OTHER)[row_bytes]) > 0
        sizes = np.diff(row_bytes)
        plain = np.repeat(~strange, sizes)
        data, kinds = texts_of.LOWER[data[plain]], kinds[plain]
        row_bytes = _bounds(sizes[~strange])
        begins = np.ones(len(data), dtype=bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
        begins[row_bytes[:-1]] = True
        starts = np.flatnonzero(begins)
        found = _binary(data, starts).dictionary_encode()
        flat, bounds = self.pieces(found.dictionary).joined(found.indices.to_numpy())
        plain_bounds = bounds[np.searchsorted(starts, row_bytes)]
        others = Ids.of(self._ids(words.filter(pa.array(strange)).to_pylist()))
        first, counts = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        first[~strange], counts[~strange] = plain_bounds[:-1], np.diff(plain_bounds)
        first[strange], counts[strange] = others.first + len(flat), others.counts
        return Ids(np.concatenate([flat, others.flat]), first, counts)

    def texts(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        """Ids of each text, then the end id. The tokenizer never joins characters across white space, so a text's ids are those of its
        words, and every distinct word is tokenized once. A NULL text is empty."""
        data, row_bytes = texts_of.text_bytes(texts, SPACES)
        begins = data == 32
        begins[row_bytes[:-1][row_bytes[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        first = np.searchsorted(starts, row_bytes)
        found = _binary(data, starts).dictionary_encode()
        del begins, starts
        word, ids = found.indices.to_numpy(), self.words(found.dictionary)
        ids = Ids(np.append(ids.flat, np.uint32(end)), np.append(ids.first, len(ids.flat)), np.append(ids.counts, 1))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(row_bytes, row_bytes[at] + texts_of.CHUNK_BYTES, "right")) - 1)
            ends = first[at + 1 : to + 1] - first[at]
            flat, bounds = ids.joined(np.insert(word[first[at] : first[to]], ends, len(ids.counts) - 1))
            bounds = bounds[np.append(0, ends + np.arange(1, len(ends) + 1))]
            yield from (flat[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
            at = to


@lru_cache(1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _pieces(capacity: int, path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = word_tokenizer(path)
        for batch in texts_of.each_chunk(batches, most=TOGETHER_BYTES):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.texts(batch.column("text"), END_ID)):
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, value in zip(out, (doc_id, piece, at, len(part), zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, capacity: int, tokenizer_path: str) -> DataFrame:
    """One row per piece of every document: its ids, then id 1; cut only where longer than the capacity."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(capacity, tokenizer_path), PIECES)


class _Plan:
    """Sequences under construction, held as groups of equal ones: (first sequence, how many) by the gap left."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.placed: list[tuple[int, int, int, int, int]] = []
        self.numbered: dict[int, int] = defaultdict(int)

    def new(self, many: int) -> int:
        first, self.sequences = self.sequences, self.sequences + many
        return first

    def put(self, length: int, first: int, many: int, offset: int) -> None:
        lo = self.numbered[length]
        self.numbered[length] = lo + many
        self.placed.append((length, lo, lo + many, first, offset))

    def leave(self, gap: int, first: int, many: int) -> None:
        if gap and many:
            self.open[gap].append((first, many))

    def match_large(self, counts: dict[int, int]) -> None:
        lengths = sorted((n for n in counts if 3 * n > self.capacity), reverse=True)
        left = {n: counts[n] for n in lengths}
        for n in lengths:
            while left[n]:
                partners = [m for m in lengths if m + n <= self.capacity and left[m] and (m != n or left[n] > 1)]
                if not partners:
                    first = self.new(left[n])
                    self.put(n, first, left[n], 0)
                    self.leave(self.capacity - n, first, left[n])
                    left[n] = 0
                    continue
                m = partners[0]
                many = left[n] // 2 if m == n else min(left[n], left[m])
                first = self.new(many)
                self.put(n, first, many, 0)
                self.put(m, first, many, n)
                self.leave(self.capacity - n - m, first, many)
                left[n] -= many
                left[m] -= many

    def fit_small(self, length: int, count: int) -> None:
        gaps = sorted(g for g in self.open if g >= length and self.open[g])
        while count:
            if gaps:
                gap = gaps[0]
                first, many = self.open[gap].pop()
                if not self.open[gap]:
                    gaps.pop(0)
            else:
                gap, many = self.capacity, -(-count // (self.capacity // length))
                first = self.new(many)
            each = min(gap // length, count)
            full = min(many, count // each)
            for k in range(each):
                self.put(length, first, full, self.capacity - gap + k * length)
            self.leave(gap - each * length, first, full)
            count -= full * each
            first, many = first + full, many - full
            if many and count < each:  # the rest shares one sequence
                for k in range(count):
                    self.put(length, first, 1, self.capacity - gap + k * length)
                if count:
                    self.leave(gap - count * length, first, 1)
                    first, many, count = first + 1, many - 1, 0
            self.leave(gap, first, many)
            if many and count:
                gaps.insert(0, gap)


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (length, lo, hi, first sequence, offset) for the given number of pieces of each length, and the
    number of sequences. Offsets are gapless from 0 in every sequence."""
    plan = _Plan(capacity)
    plan.match_large(counts)
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        plan.fit_small(length, counts[length])
    return plan.placed, plan.sequences


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 4096, tokenizer_path: str | None = None) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. A NULL or empty text is the end id
    alone. A NULL doc_id is kept as such; repeated rows are packed as often as they occur; other columns are ignored. An
    empty table gives no rows.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = workspace(spark, "pieces")
    tokenized_pieces(docs, capacity, tokenizer_path).write.parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = spark.read.parquet(path).withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, start), {buckets})"))
    per_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("pieces"))
    bucket_path = workspace(spark, "piece-counts")
    per_bucket.write.parquet(bucket_path)
    per_bucket = spark.read.parquet(bucket_path)
    counts = {r["length"]: r["pieces"] for r in per_bucket.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    placed, _ = packing_plan(counts, capacity)
    grouped = defaultdict(list)
    for length, *interval in placed:
        grouped[length].append(interval)
    lengths = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(rows))) for n, rows in grouped.items()}
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select("length", "bucket", F.coalesce(F.sum("pieces").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("number"))
    )

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty_like(number), np.empty_like(number)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                lo, _, base, at = lengths[int(n)]
                slot = np.searchsorted(lo, number[rows], "right") - 1
                sequence[rows], offset[rows] = base[slot] + number[rows] - lo[slot], at[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")
