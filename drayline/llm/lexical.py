"""Ranked lexical search: the best documents of each item, by branch and bound over a trie of restricted term vectors.

A first pass over the texts keeps of every document its number of terms and the frequencies of the items' terms, and counts
documents. The search then takes these vectors in chunks. For an item, the chunk's vectors are restricted to the item's terms,
ordered from the most frequent term to the rarest, and put into a trie, in which vectors with the same beginning share
a path. A node carries the greatest frequency of its term and the least length norm ``m`` among the documents below it;
the score grows with the first and falls with the second, so the sum of a path's shares at these values, with the
best continuation below, bounds every document of a subtree. The trie is walked depth first, best child first, and
a subtree whose bound is below the item's k-th best score so far is left out. Documents are only scored where the walk
gets to. A task sends its k best of every item, and Spark ranks them.

Items are taken in blocks of about ``block_terms`` terms (by hash of the row, so each is one broadcast of bounded size), with one pass each.

Terms are compared by 64-bit hashes. A NULL or empty text has no terms: such documents are not counted and such items
give no rows. Every row of ``items`` is ranked for itself, also where ids repeat, and every row of ``docs`` is
a document; equal scores fall to the smaller doc_id, NULL last. Only the named columns of either table are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drayline.llm import text as texts
from drayline.session import workspace

BLOCK_TERMS = 1_000_000
CHUNK_DOCUMENTS = 1 << 16
CHUNK_POSTINGS = 1 << 23
TERMS = "item_row long, item_id long, terms array<long>"
VECTORS = "doc_id long, n long, terms array<int>, frequencies array<long>"
FOUND = "item_row long, item_id long, doc_id long, score long"

#: Bytes of terms, A-Z in lower case; all others become spaces.
TERM_BYTES = np.full(256, 32, dtype=np.uint8)
TERM_BYTES[48:58] = np.arange(48, 58)
TERM_BYTES[65:91] = np.arange(97, 123)
TERM_BYTES[97:123] = np.arange(97, 123)
TERM_BYTES[128:] = np.arange(128, 256)


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in texts.each_chunk(batches):
        w = texts.words(part.column("text"), TERM_BYTES)
        per_row = [np.unique(w.hashes[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in per_row])])
        terms = texts.lists(texts.signed(np.concatenate(per_row)), bounds, pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("item_row"), part.column("item_id"), terms], ["item_row", "item_id", "terms"])


def _vectors(vocabulary: np.ndarray):
    """``vocabulary``: the sorted hashes of a block's terms. A term's number is its place there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts.each_chunk(batches):
            w = texts.words(part.column("text"), TERM_BYTES)
            at = np.minimum(np.searchsorted(vocabulary, w.hashes), len(vocabulary) - 1)
            held = vocabulary[at] == w.hashes
            pairs, frequencies = np.unique(w.row_of[held] * len(vocabulary) + at[held], return_counts=True)
            rows, terms = np.divmod(pairs, len(vocabulary))
            bounds = np.searchsorted(rows, np.arange(w.rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(w.first), type=pa.int64()),
                    texts.lists(terms, bounds, pa.int32()),
                    texts.lists(frequencies, bounds, pa.int64()),
                ],
                ["doc_id", "n", "terms", "frequencies"],
            )

    return run


class Chunk:
    """Vectors of a few documents, by term: ``documents[first[t]:first[t + 1]]`` hold term t, in order."""

    def __init__(self, batches: list[pa.RecordBatch], corpus_documents: int, corpus_terms: int, vocabulary: int):
        ids = pa.concat_arrays([b.column(0) for b in batches])
        self.null_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.doc_id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        n = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in batches])
        self.m = 50 + (50 * n * corpus_documents) // corpus_terms
        sizes = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in batches])
        terms = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in batches])
        frequencies = np.concatenate([b.column(3).flatten().to_numpy(zero_copy_only=False) for b in batches])
        order = np.argsort(terms, kind="stable")
        self.documents = np.repeat(np.arange(len(n)), sizes)[order]
        self.frequencies = frequencies[order]
        self.first = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.node_of = np.zeros(len(n), dtype=np.int64)

    def postings(self, term: int) -> slice:
        return slice(self.first[term], self.first[term + 1])


def share(weight: np.ndarray, frequency: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score; grows with the frequency and falls with m."""
    return weight * ((1_000_000_000 * frequency) // (1000 * frequency + 20 * m))


class Trie:
    """A chunk's vectors restricted to an item's terms, as paths from the root, 0. Nodes are numbered in order of their term, so
    a parent comes before its children."""

    def __init__(self, chunk: Chunk, terms: list[int], weights: np.ndarray):
        self.chunk = chunk
        node_of, no_weight = chunk.node_of, np.zeros(1, dtype=np.int64)
        parents, own, levels, held, total = [np.array([-1])], [no_weight], [], [], 1
        for t in terms:
            at = chunk.postings(t)
            if at.start == at.stop:
                continue
            above = node_of[chunk.documents[at]]
            order = np.argsort(above, kind="stable")
            documents, frequencies, above = chunk.documents[at][order], chunk.frequencies[at][order], above[order]
            starts = np.flatnonzero(np.diff(above, prepend=-1))
            # Of the documents that come through each new node: greatest frequency of its term, least m.
            greatest, least = np.maximum.reduceat(frequencies, starts), np.minimum.reduceat(chunk.m[documents], starts)
            parents.append(above[starts])
            own.append(share(weights[t], greatest, least))
            node_of[documents] = total + np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(documents))))
            levels.append(slice(total, total + len(starts)))
            held.append((documents, frequencies, np.full(len(documents), weights[t])))
            total += len(starts)
        self.parent, own = np.concatenate(parents), np.concatenate(own)
        above, below = own.copy(), np.zeros(total, dtype=np.int64)
        for level in levels:
            above[level] += above[self.parent[level]]
        for level in reversed(levels):  # a node has one child a term at most
            up = self.parent[level]
            below[up] = np.maximum(below[up], own[level] + below[level])
        self.bound = above + below
        self.children = np.argsort(self.parent, kind="stable")[1:]
        self.first_child = np.searchsorted(self.parent[self.children], np.arange(total + 1))
        self._keep_vectors(*(np.concatenate([h[i] for h in held] or [no_weight[:0]]) for i in range(3)))

    def _keep_vectors(self, documents: np.ndarray, frequencies: np.ndarray, weights: np.ndarray) -> None:
        """The restricted vectors, one after the other in the order of the nodes they end at; those of a node have the same terms."""
        ends = self.chunk.node_of[documents]
        order = np.lexsort((documents, ends))  # stable, so a vector's terms keep their order
        documents, ends, self.frequencies, self.weights = documents[order], ends[order], frequencies[order], weights[order]
        self.chunk.node_of[documents] = 0  # as the next item needs it
        self.starts = np.flatnonzero(np.diff(documents, prepend=-1) | np.diff(ends, prepend=-1))
        self.ending = documents[self.starts]
        self.first_ending = np.searchsorted(ends[self.starts], np.arange(len(self.parent) + 1))
        self.starts = np.append(self.starts, len(documents))

    def score(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents whose vector ends at a node and their scores."""
        first, last = self.first_ending[node], self.first_ending[node + 1]
        documents, at = self.ending[first:last], slice(self.starts[first], self.starts[last])
        shape = len(documents), -1
        shares = share(self.weights[at].reshape(shape), self.frequencies[at].reshape(shape), self.chunk.m[documents][:, None])
        return documents, shares.sum(axis=1)


class Best:
    """The k best documents of an item so far, and the score a further one must reach."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score = np.zeros(0, dtype=np.int64)
        self.doc_id, self.null_id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def add(self, score: np.ndarray, doc_id: np.ndarray, null_id: np.ndarray) -> None:
        keep = score >= self.floor
        if not keep.any():
            return
        score, doc_id, null_id = (np.concatenate(p) for p in ((self.score, score[keep]), (self.doc_id, doc_id[keep]), (self.null_id, null_id[keep])))
        order = np.lexsort((doc_id, null_id, -score))[: self.k]
        self.score, self.doc_id, self.null_id = score[order], doc_id[order], null_id[order]
        if len(order) == self.k:
            self.floor = int(self.score[-1])


def search(trie: Trie, best: Best) -> int:
    """Walks the trie depth first, best child first; returns the nodes visited. A bound equal to the k-th score is followed, as
    a document there may have the smaller id."""
    chunk, waiting, visited = trie.chunk, [0], 0
    while waiting:
        node = waiting.pop()
        if trie.bound[node] < best.floor:
            continue
        visited += 1
        if node and trie.first_ending[node] < trie.first_ending[node + 1]:
            documents, scores = trie.score(node)
            best.add(scores, chunk.doc_id[documents], chunk.null_id[documents])
        children = trie.children[trie.first_child[node] : trie.first_child[node + 1]]
        children = children[trie.bound[children] >= best.floor]
        waiting.extend(children[np.argsort(trie.bound[children], kind="stable")].tolist())
    return visited


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, documents, postings = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        documents, postings = documents + batch.num_rows, postings + len(batch.column(2).flatten())
        if documents >= CHUNK_DOCUMENTS or postings >= CHUNK_POSTINGS:
            yield held
            held, documents, postings = [], 0, 0
    if held:
        yield held


def _search(items, weights, corpus_documents: int, corpus_terms: int, k: int):
    """``items``: broadcast (item_row, item_id, terms from the most frequent on) of a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items.value]
        for held in _chunks(batches):
            chunk = Chunk(held, corpus_documents, corpus_terms, len(weights.value))
            for (_, _, terms), found in zip(items.value, best):
                search(Trie(chunk, terms, weights.value), found)
        for (item_row, item_id, _), found in zip(items.value, best):
            n = len(found.score)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item_row] * n, type=pa.int64()),
                        pa.array([item_id] * n, type=pa.int64()),
                        pa.array(found.doc_id, type=pa.int64(), mask=found.null_id),
                        pa.array(found.score, type=pa.int64()),
                    ],
                    ["item_row", "item_id", "doc_id", "score"],
                )

    return run


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _block(spark: SparkSession, docs: DataFrame, items: list, k: int) -> DataFrame:
    """The k best per task and item of one block of items."""
    context = spark.sparkContext
    vocabulary = np.unique(np.concatenate([np.array(r.terms, dtype=np.int64) for r in items]).view(np.uint64))
    path = workspace(spark, "term-vectors")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_vectors(vocabulary), VECTORS).write.parquet(path)
    vectors = spark.read.schema(VECTORS).parquet(path)
    documents, terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary), dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[r["term"]] = r["count"]
    weights = np.array([weight(documents, int(d)) for d in holding], dtype=np.int64)

    def ordered(hashes: list[int]) -> list[int]:
        places = np.searchsorted(vocabulary, np.array(hashes, dtype=np.int64).view(np.uint64))
        places = places[holding[places] > 0]
        return places[np.lexsort((places, -holding[places]))].tolist()

    sent = context.broadcast([(r.item_row, r.item_id, ordered(r.terms)) for r in items])
    return vectors.where(F.size("terms") > 0).mapInArrow(_search(sent, context.broadcast(weights), documents, max(terms, 1), k), FOUND)


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    path = workspace(spark, "item-terms")
    rows = items.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long").alias("item_id"), "text")
    rows.mapInArrow(_item_terms, TERMS).write.parquet(path)
    asked = spark.read.schema(TERMS).parquet(path).where(F.size("terms") > 0)
    blocks = math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms)
    found = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == b).collect()
        if held:
            found.append(_block(spark, docs, held, k))
    best = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
