"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words enter in two spellings: lower-cased letters, and their shape (case, digits, punctuation with runs collapsed). A word
that repeats its predecessor is the token REPEAT, and a three-word run seen before in the text adds the token AGAIN, so
that n-grams of them speak for texts whose words were never seen. A feature's value is its share of the row's n-grams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.llm import linear, text

BUCKETS = 1 << 18
SAMPLE_ROWS = 8_000
EPOCHS = 4
REPEAT, AGAIN, FRESH = (np.uint64(k) for k in (0x52455045, 0x41474149, 0x46524553))

LETTERS = text.LOWER.copy()
LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 32
SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[97:123] = SHAPES[128:] = 97
SHAPES[65:91] = 65
SHAPES[48:58] = 48


def shape_words(texts: pa.Array) -> text.Words:
    data, row_bytes = text.text_bytes(texts, SHAPES)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = data[1:] != data[:-1]
    keep[row_bytes[:-1][row_bytes[:-1] < len(data)]] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    return text.scan(data[keep], kept_before[row_bytes])


def features(texts: pa.Array) -> linear.SparseRows:
    letters, shapes = text.words(texts, LETTERS), shape_words(texts)
    tokens, row = letters.hashes.copy(), letters.row_of
    same = np.zeros(len(tokens), dtype=bool)
    same[1:] = (letters.hashes[1:] == letters.hashes[:-1]) & (row[1:] == row[:-1])
    tokens[same] = REPEAT
    keys, rows = [], []

    def add(template: int, hashes: np.ndarray, of: np.ndarray) -> None:
        keys.append(text.mix(hashes ^ np.uint64(template << 56)))
        rows.append(of)

    def grams(template: int, hashes: np.ndarray, of: np.ndarray, n: int) -> None:
        whole = of[: len(of) - n + 1] == of[n - 1 :] if len(of) >= n else np.zeros(0, dtype=bool)
        rolled = hashes[: len(whole)].copy()
        with np.errstate(over="ignore"):
            for k in range(1, n):
                rolled = text.mix(rolled) + hashes[k : k + len(whole)]
        add(template, rolled[whole], of[: len(whole)][whole])

    grams(1, tokens, row, 1)
    grams(2, tokens, row, 2)
    for n in (1, 2, 3):
        grams(2 + n, shapes.hashes, shapes.row_of, n)
    three, three_row = text.ngrams(letters, 3)
    order = np.lexsort((np.arange(len(three)), three, three_row))
    seen = np.zeros(len(three), dtype=bool)
    seen[order[1:]] = (three[order[1:]] == three[order[:-1]]) & (three_row[order[1:]] == three_row[order[:-1]])
    add(6, np.where(seen, AGAIN, FRESH), three_row)
    values = [1.0 / np.maximum(1, np.bincount(r, minlength=letters.rows))[r] for r in rows]
    return linear.collect_rows(keys, rows, values, letters.rows, BUCKETS)


def train(labelled: DataFrame, label: str = "label", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from at most about ``sample_rows`` rows (doc_id, text, label 0/1). Without rows: all 0."""
    rows = list(linear.sampled_features(linear.bounded_sample(labelled.where(F.col(label).isNotNull()), sample_rows), label, features))
    model = linear.Ftrl(BUCKETS + 1, alpha=0.5, l1=1e-3, l2=1e-3)
    random = np.random.default_rng(5)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            y, at, value = rows[i]
            at, value = np.append(at, BUCKETS), np.append(value, 1.0)
            w = model.weights(at)
            model.update(at, w, (linear.sigmoid(float(w @ value)) - y) * value)
    weights = model.weights()
    return weights[:BUCKETS].astype(np.float32), float(weights[BUCKETS])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, score (likelihood of label 1) and predicted for every whole text.

    A NULL or empty text has no n-grams and gets the likelihood of the bias. Ids may be NULL or repeat: one result per row.
    Other columns are not read. An empty table gives no rows.
    """

    def finish(sums: np.ndarray) -> list[pa.Array]:
        p = linear.sigmoid(sums)
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return linear.score_rows(docs, features, finish, *model, "score double, predicted int")


def accepted(batches: Iterable[pa.RecordBatch], weights: np.ndarray, bias: float, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in text.each_chunk(batches, most=linear.FEATURE_BYTES):
        score = linear.sigmoid(features(batch.column("text")).scores(weights, bias))
        yield batch.filter(pa.array(score >= threshold))


def keep_accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold. Nothing is shuffled."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return accepted(batches, shared.value, bias, threshold)

    return docs.mapInArrow(run, docs.schema)


def labelled_documents(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Training rows: documents with a label, in the folds learned from. A doc_id that repeats in labels counts once."""
    ids = labels.where(F.col(column).isNotNull()).groupBy(F.col("doc_id")).agg(F.max(column).alias("label"))
    return docs.select("doc_id", "text").where(linear.fold() != 0).join(ids, "doc_id")
