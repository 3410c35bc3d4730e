"""Hashed sparse features as Arrow rows, a follow-the-regularised-leader learner, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.llm import text

#: Text whose features are made at once; they take some hundred times its bytes.
FEATURE_BYTES = 1 << 18


@dataclass
class SparseRows:
    index: np.ndarray
    value: np.ndarray
    bounds: np.ndarray

    def scores(self, weights: np.ndarray, bias: float = 0.0) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.index] * self.value, dtype=np.float64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]] + bias


def collect_rows(keys: list[np.ndarray], rows: list[np.ndarray], values: list[np.ndarray], n_rows: int, buckets: int) -> SparseRows:
    """Hashed keys of all templates together; values of the same bucket of a row are added."""
    row = np.concatenate(rows).astype(np.int64)
    bucket = (np.concatenate(keys) % np.uint64(buckets)).astype(np.int64)
    cells, where = np.unique(row * buckets + bucket, return_inverse=True)
    value = np.bincount(where, np.concatenate(values), minlength=len(cells))
    return SparseRows(cells % buckets, value, np.searchsorted(cells, np.arange(n_rows + 1) * buckets))


Featurizer = Callable[[pa.Array], SparseRows]


class Ftrl:
    """Per-coordinate follow-the-regularised-leader weights: sparse, with steps that shrink where gradients were."""

    def __init__(self, size: int, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        squares = gradient * gradient
        step = (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - step * weights
        self.n[at] += squares


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """Every row where there are no more than ``most``; else a share by hash of doc_id that is expected to be so many."""
    n = rows.count()
    return rows if n <= most else rows.where(F.expr(f"pmod(xxhash64(doc_id, 17), 1000000) < {int(1e6 * most / n)}"))


def sampled_features(rows: DataFrame, label: str, featurize: Featurizer) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(label, bucket, value) of each row, made on the executors; for a bounded sample only. Ordered by doc_id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.each_chunk(batches, most=FEATURE_BYTES):
            f = featurize(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), text.lists(f.index.astype(np.int32), f.bounds, pa.int32()), text.lists(f.value.astype(np.float32), f.bounds, pa.float32())],
                ["doc_id", "label", "bucket", "value"],
            )

    found = rows.select("doc_id", F.col(label).cast("int").alias("label"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, label int, bucket array<int>, value array<float>")
    table = found.toArrow().combine_chunks()
    if not table.num_rows:
        return
    doc_id, label = (table.column(c).to_numpy() for c in ("doc_id", "label"))
    lists = [table.column(c).chunk(0) for c in ("bucket", "value")]
    bounds = lists[0].offsets.to_numpy()
    bucket, value = (c.values.to_numpy() for c in lists)
    # slices of the collected columns: the sample is held once
    for i in np.lexsort((label, doc_id)):
        yield int(label[i]), bucket[bounds[i] : bounds[i + 1]], value[bounds[i] : bounds[i + 1]]


def score_rows(docs: DataFrame, featurize: Featurizer, finish: Callable[[np.ndarray], list[pa.Array]], weights: np.ndarray, bias: float, added: str) -> DataFrame:
    """doc_id and the columns that ``finish`` makes of each whole text's weighted sum. Weights have a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.each_chunk(batches):
            done = finish(featurize(batch.column("text")).scores(shared.value, bias))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *done], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {added}")


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x)))


def fold(divisor: int = 5) -> F.Column:
    """The remainder of the CRC-32 of the id's decimal text; NULL for a NULL id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
