"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - threshold_k) with one weight vector for all thresholds, which are kept in order. Features
are presence of words and of word beginnings. The expected severity is the sum of these likelihoods over k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayline.llm import linear, text
from drayline.llm.quality import LETTERS

BUCKETS = 1 << 20
SAMPLE_ROWS = 16_000
EPOCHS = 8
PREFIX_BYTES = (4, 5, 6)


def features(texts: pa.Array) -> linear.SparseRows:
    w = text.words(texts, LETTERS)
    keys, rows = [text.mix(w.hashes)], [w.row_of]
    for n in PREFIX_BYTES:
        long = w.end - w.start > n
        keys.append(text.mix(w.part_hashes(w.start[long], w.start[long] + n) ^ np.uint64(n)))
        rows.append(w.row_of[long])
    found = linear.collect_rows(keys, rows, [np.ones(len(k)) for k in keys], w.rows, BUCKETS)
    found.value = np.ones(len(found.index))
    return found


def graded(rows: list[tuple[int, np.ndarray, np.ndarray]], severe_share: float = 0.5) -> list[tuple[int, np.ndarray]]:
    """Severity grades 0, 1, 2 from a binary label: a toxic text is severe when it holds at least as many indicative
    features as the median toxic text. Indicative: in 5 or more toxic texts of the sample and in none that is clean."""
    toxic, clean = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for y, at, _ in rows:
        (toxic if y else clean)[at] += 1
    indicative = (toxic >= 5) & (clean == 0)
    hits = [int(indicative[at].sum()) for _, at, _ in rows]
    positive = [h for (y, _, _), h in zip(rows, hits) if y]
    cut = max(1.0, float(np.quantile(positive, severe_share))) if positive else 1.0
    return [(0 if not y else 2 if h >= cut else 1, at) for (y, at, _), h in zip(rows, hits)]


def selected(rows: list[tuple[int, np.ndarray]], least: int = 4, lift: float = 3.0) -> np.ndarray:
    """Features in at least ``least`` toxic texts of the sample that are ``lift`` times as frequent there as in all texts.

    The words that every text is made of say nothing about a grade; in a long text their small weights would add up."""
    toxic, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for y, at in rows:
        every[at] += 1
        if y:
            toxic[at] += 1
    share = max(1, sum(y > 0 for y, _ in rows)) / len(rows)
    return (toxic >= least) & (toxic >= lift * share * every)


def train(labelled: DataFrame, label: str = "label", sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and the ordered thresholds from at most about ``sample_rows`` labelled rows. Only the
    features that ``selected`` picks get a weight. Without rows every text has grade 0."""
    rows = graded(list(linear.sampled_features(linear.bounded_sample(labelled.where(F.col(label).isNotNull()), sample_rows), label, features)))
    if not rows:
        return np.zeros(BUCKETS, dtype=np.float32), np.array([10.0, 11.0])
    chosen = selected(rows)
    rows = [(y, at[chosen[at]]) for y, at in rows]
    model = linear.Ftrl(BUCKETS, alpha=3.0, l1=1.0, l2=1e-3)
    share = [np.clip(np.mean([y > k for y, _ in rows]), 1e-3, 1 - 1e-3) for k in range(2)]
    cuts = np.log((1 - np.array(share)) / np.array(share))
    random, steps = np.random.default_rng(9), np.zeros(2)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            y, at = rows[i]
            w = model.weights(at)
            s = float(w.sum())
            above = linear.sigmoid(s - cuts)
            # likelihood of the grade is a difference of neighbouring likelihoods of being above
            upper, lower = (1.0 if y == 0 else above[y - 1]), (0.0 if y == 2 else above[y])
            p = max(upper - lower, 1e-6)
            d_upper = above[y - 1] * (1 - above[y - 1]) if y > 0 else 0.0
            d_lower = above[y] * (1 - above[y]) if y < 2 else 0.0
            slope = -(d_upper - d_lower) / p
            model.update(at, w, np.full(len(at), slope))
            cut_gradient = np.zeros(2)
            if y > 0:
                cut_gradient[y - 1] += d_upper / p
            if y < 2:
                cut_gradient[y] -= d_lower / p
            steps += cut_gradient**2
            cuts -= 0.3 * cut_gradient / (1.0 + np.sqrt(steps))
            cuts[1] = max(cuts[1], cuts[0] + 0.05)
    return model.weights().astype(np.float32), cuts


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], toxic_at: float = 0.3) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, p_severe, grade and toxic (0/1) of every whole text.

    Toxic: the likelihood of a grade above 0 is at least ``toxic_at``; the grade is then the likelier of 1 and 2.

    A NULL or empty text has no features and gets the likelihoods of the thresholds alone. Ids may be NULL or repeat: one
    result per row. Other columns are not read. An empty table gives no rows.
    """
    weights, cuts = model

    def finish(sums: np.ndarray) -> list[pa.Array]:
        above = [linear.sigmoid(sums - c) for c in cuts]
        each = np.stack([1 - above[0], above[0] - above[1], above[1]])
        toxic = above[0] >= toxic_at
        grade = np.where(toxic, 1 + (each[2] >= each[1]), 0)
        return [pa.array(above[0] + above[1]), pa.array(above[0]), pa.array(above[1]), pa.array(grade.astype(np.int32)), pa.array(toxic.astype(np.int32))]

    return linear.score_rows(docs, features, finish, weights, 0.0, "severity double, p_toxic double, p_severe double, grade int, toxic int")
