"""Hashed maximum-entropy language model with n-gram and skip features and a class-factored softmax.

P(token | history) = P(class | history) P(token | class). The classes are clusters of frequent words by the words before
them, clusters of the endings of all other words, and the end of the text. The class softmax has hashed weights for the
previous word, the word before it (a skip), and the classes of the last two and three tokens; they are trained on every
training text by gradient steps in each task, whose changes are averaged by feature. The softmax inside a class has a
bias per word, whose best value is the log of its count plus a half; one half per class is left for unseen words.

Counts cover all training texts. The most frequent words (a fixed number) are held by every task; counts of the others
are joined by a shuffle. Per-class, per-feature and per-ending tables have fixed sizes.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.llm import linear, text
from drayline.session import workspace

TOP_WORDS = 1 << 18
HEAD_WORDS = 1 << 14
ENDINGS = 256
ANCHORS = 64
HEAD_CLASSES, RARE_CLASSES = 15, 8
CLASSES = HEAD_CLASSES + RARE_CLASSES + 1
BUCKETS = 1 << 14
ROUNDS = 2
STEP_TOKENS = 16_384
END, START = np.uint64(0x454E44), np.uint64(0x535441)


@dataclass
class Tokens:
    """Tokens of a chunk, each row's words followed by its end."""

    hashes: np.ndarray
    row: np.ndarray
    place: np.ndarray  # within the row
    ending: np.ndarray  # bucket of the last bytes


def tokens(texts: pa.Array) -> Tokens:
    w = text.words(texts)
    counts = np.diff(w.first)
    at = np.arange(len(w.hashes)) + w.row_of
    hashes, ending = np.full(len(w.hashes) + w.rows, END), np.zeros(len(w.hashes) + w.rows, dtype=np.int64)
    hashes[at] = w.hashes
    ending[at] = (w.part_hashes(np.maximum(w.start, w.end - 2), w.end) % np.uint64(ENDINGS)).astype(np.int64)
    row = np.repeat(np.arange(w.rows), counts + 1)
    return Tokens(hashes, row, np.arange(len(row)) - (w.first[:-1] + np.arange(w.rows))[row], ending)


def shifted(values: np.ndarray, place: np.ndarray, by: int, blank) -> np.ndarray:
    """The value ``by`` tokens earlier in the same row."""
    out = np.full_like(values, blank)
    out[by:] = values[:-by]
    out[place < by] = blank
    return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for part in text.each_chunk([batch]):
            t = tokens(part.column("text"))
            words, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
            found.append((words, t.ending[first], n))
        words, ending, n = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        words, first, where = np.unique(words, return_index=True, return_inverse=True)
        total = np.bincount(where, n, minlength=len(words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(text.signed(words)), pa.array(ending[first].astype(np.int32)), pa.array(total)], ["word", "ending", "seen"])


@dataclass
class Vocabulary:
    """The most frequent words: sorted hashes, their counts, and the number among the head words (-1: none)."""

    words: np.ndarray
    seen: np.ndarray
    head: np.ndarray
    anchors: np.ndarray  # head number to anchor number, -1: none

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place in ``words``, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    end = int(text.signed(np.array([END]))[0])
    top = counts.where(F.col("word") != end).orderBy(F.desc("seen"), "word").limit(TOP_WORDS).select("word", "seen").toArrow()
    words, seen = top.column("word").to_numpy().view(np.uint64), top.column("seen").to_numpy()
    by_count = np.lexsort((words, -seen))
    head = np.full(len(words), -1, dtype=np.int64)
    head[by_count[:HEAD_WORDS]] = np.arange(min(HEAD_WORDS, len(words)))
    order = np.argsort(words)
    anchors = np.full(HEAD_WORDS + 1, -1, dtype=np.int64)
    anchors[:ANCHORS] = np.arange(ANCHORS)
    return Vocabulary(words[order], seen[order], head[order], anchors)


def _neighbours(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        total = np.zeros((HEAD_WORDS + ENDINGS) * ANCHORS, dtype=np.int64)
        for batch in text.each_chunk(batches):
            t = tokens(batch.column("text"))
            at = v.find(t.hashes)
            head = np.where(at >= 0, v.head[at], -1) if len(v.head) else at
            unit = np.where(head >= 0, head, HEAD_WORDS + t.ending)
            anchor = v.anchors[head]
            before = np.maximum(shifted(anchor, t.place, 1, -1), shifted(anchor, t.place, 2, -1))
            use = (before >= 0) & (t.hashes != END)
            total += np.bincount(unit[use] * ANCHORS + before[use], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    return run


def clusters(vectors: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means on square roots of shares, started from spread-out rows; the same rows give the same clusters."""
    x = np.sqrt((vectors + 0.02) / (vectors.sum(axis=1, keepdims=True) + 0.02 * vectors.shape[1]))
    centres = [x[int(np.argmax(weight))]]
    for _ in range(k - 1):
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[int(np.argmax(far * np.sqrt(weight)))])
    c = np.stack(centres)
    for _ in range(rounds):
        label = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        for i in range(k):
            mine = label == i
            if weight[mine].sum() > 0:
                c[i] = np.average(x[mine], axis=0, weights=weight[mine])
    return label


@dataclass
class Model:
    vocabulary: Vocabulary
    head_class: np.ndarray
    ending_class: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    mass: np.ndarray  # of counts plus a half, by class; half a count for unseen words is in the rare ones
    log_total: float  # of the base distribution
    train_tokens: int

    def classes(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(place among the top words, class) of every token."""
        at = self.vocabulary.find(t.hashes)
        head = np.where(at >= 0, self.vocabulary.head[at], -1) if len(self.vocabulary.head) else at
        kind = np.where(head >= 0, self.head_class[head], self.ending_class[t.ending])
        return at, np.where(t.hashes == END, CLASSES - 1, kind)

    def features(self, t: Tokens, kind: np.ndarray) -> list[np.ndarray]:
        one, two = shifted(t.hashes, t.place, 1, START), shifted(t.hashes, t.place, 2, START)
        k = [shifted(kind, t.place, i, CLASSES).astype(np.uint64) for i in (1, 2, 3)]
        width = np.uint64(CLASSES + 1)
        pair = k[0] * width + k[1]
        keys = (one ^ np.uint64(1), two ^ np.uint64(1 << 62), pair + np.uint64(1 << 40), pair * width + k[2] + np.uint64(1 << 50))
        return [(text.mix(x) % np.uint64(BUCKETS)).astype(np.int64) for x in keys]

    def log_likelihoods(self, features: list[np.ndarray]) -> np.ndarray:
        s = self.weights[features[0]]
        for f in features[1:]:
            s += self.weights[f]
        s += self.bias
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        return s


def _steps(shared, rate: float):
    """Gradient steps over the texts of one task; gives each feature's change, times its tokens, and the tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        model = Model(**{**vars(model), "weights": model.weights.copy()})
        squares = np.full((BUCKETS, CLASSES), 1e-3, dtype=np.float32)
        used = np.zeros(BUCKETS, dtype=np.int64)
        for batch in text.each_chunk(batches):
            t = tokens(batch.column("text"))
            _, kind = model.classes(t)
            features = model.features(t, kind)
            for low in range(0, len(kind), STEP_TOKENS):
                part = [f[low : low + STEP_TOKENS] for f in features]
                gradient = np.exp(model.log_likelihoods(part))
                gradient[np.arange(len(gradient)), kind[low : low + STEP_TOKENS]] -= 1.0
                for f in part:
                    order = np.argsort(f, kind="stable")
                    f = f[order]
                    first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                    rows, sums = f[first], np.add.reduceat(gradient[order], first, axis=0)
                    squares[rows] += sums * sums
                    model.weights[rows] -= rate * sums / np.sqrt(squares[rows])
                    used[rows] += np.diff(np.append(first, len(f)))
        some = np.flatnonzero(used)
        change = (model.weights[some] - shared.value.weights[some]) * used[some, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(used[some]), *(pa.array(change[:, i].astype(np.float32)) for i in range(CLASSES))],
            ["bucket", "used", *(f"w{i}" for i in range(CLASSES))],
        )

    return run


def train(spark: SparkSession, docs: DataFrame, counts: DataFrame, rate: float = 0.15) -> Model:
    """A model of the training texts ``docs`` (text), whose token counts are ``counts`` (word, ending, seen)."""
    end = int(text.signed(np.array([END]))[0])
    totals = counts.agg(F.sum("seen").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == end, F.col("seen"))).alias("ends")).first()
    n, distinct, ends = totals["n"] or 0, totals["v"], totals["ends"] or 0
    v = vocabulary(counts)
    near = np.zeros((HEAD_WORDS + ENDINGS) * ANCHORS)
    for batch in docs.mapInArrow(_neighbours(spark.sparkContext.broadcast(v)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        near[batch.column("cell").to_numpy()] = batch.column("n").to_numpy()
    near = near.reshape(-1, ANCHORS)
    head_seen = np.zeros(HEAD_WORDS)
    head_seen[v.head[v.head >= 0]] = v.seen[v.head >= 0]
    by_ending = {r["ending"]: r["m"] for r in counts.where(F.col("word") != end).groupBy("ending").agg(F.sum(F.col("seen") + 0.5).alias("m")).collect()}
    ending_mass = np.array([float(by_ending.get(i, 0.0)) for i in range(ENDINGS)])
    head_words = v.head >= 0
    if head_words.any():
        head_ending = {r["word"]: r["ending"] for r in counts.join(F.broadcast(spark.createDataFrame([(int(w),) for w in text.signed(v.words[head_words])], "word long")), "word").select("word", "ending").collect()}
        for word, seen in zip(text.signed(v.words[head_words]).tolist(), v.seen[head_words].tolist()):
            ending_mass[head_ending[word]] -= seen + 0.5
    head_class = clusters(near[:HEAD_WORDS], head_seen + 1e-9, HEAD_CLASSES)
    ending_class = HEAD_CLASSES + clusters(near[HEAD_WORDS:], np.maximum(ending_mass, 0) + 1e-9, RARE_CLASSES)
    mass = np.zeros(CLASSES)
    np.add.at(mass, head_class[: min(HEAD_WORDS, int(head_words.sum()))], head_seen[: int(head_words.sum())] + 0.5)
    np.add.at(mass, ending_class, np.maximum(ending_mass, 0))
    mass[HEAD_CLASSES : HEAD_CLASSES + RARE_CLASSES] += 0.5
    mass[CLASSES - 1] = ends + 0.5
    bias = np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32)
    model = Model(v, head_class, ending_class, bias, np.zeros((BUCKETS, CLASSES), dtype=np.float32), mass, float(np.log10(n + 0.5 * (distinct + 1))), int(n))
    columns = [f"w{i}" for i in range(CLASSES)]
    schema = "bucket int, used long, " + ", ".join(f"{c} float" for c in columns)
    for r in range(ROUNDS):
        share = docs.where(F.expr(f"pmod(xxhash64(doc_id, 29), {ROUNDS}) = {r}"))
        steps = share.mapInArrow(_steps(spark.sparkContext.broadcast(model), rate), schema)
        mean = steps.groupBy("bucket").agg(F.sum("used").alias("used"), *(F.sum(c).alias(c) for c in columns))
        weights = model.weights.copy()
        for batch in mean.toArrow().to_batches():
            used = batch.column("used").to_numpy()
            change = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
            weights[batch.column("bucket").to_numpy()] += (change / used[:, None]).astype(np.float32)
        model = Model(**{**vars(model), "weights": weights})
    return model


LN10 = float(np.log(10.0))
PARTS = "doc_id long, row long, n_tokens long, n_known long, base_score double, score double, tail_words array<long>, tail_seen array<int>"


def _score(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        end_seen = m.mass[CLASSES - 1]
        log_mass = np.log10(np.maximum(m.mass, 1e-300))
        for batch in text.each_chunk(batches):
            t = tokens(batch.column("text"))
            rows = batch.num_rows
            at, kind = m.classes(t)
            history = np.concatenate([m.log_likelihoods([f[low : low + STEP_TOKENS] for f in fs])[np.arange(min(STEP_TOKENS, len(kind) - low)), kind[low : low + STEP_TOKENS]] for fs in [m.features(t, kind)] for low in range(0, len(kind), STEP_TOKENS)]).astype(np.float64) / LN10
            is_end, tail = t.hashes == END, (at < 0) & (t.hashes != END)
            own = np.zeros(len(kind))
            if len(m.vocabulary.seen):
                own = np.where(at >= 0, np.log10(m.vocabulary.seen[at] + 0.5), own)
            own[is_end] = np.log10(end_seen)
            known = (at >= 0) | (is_end & (end_seen > 0.5))
            by_row = lambda x: np.bincount(t.row, x, minlength=rows)
            n = np.bincount(t.row, minlength=rows)
            base = by_row(own) - n * m.log_total
            score = by_row(history + own - log_mass[kind])
            order = np.flatnonzero(tail)
            order = order[np.lexsort((t.hashes[order], t.row[order]))]
            h, r = t.hashes[order], t.row[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
            bounds = np.searchsorted(r[first], np.arange(rows + 1))
            seen = np.diff(np.append(first, len(h)))
            keys = np.frombuffer(os.urandom(8 * rows), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys), pa.array(n), pa.array(by_row(known).astype(np.int64)), pa.array(base), pa.array(score), text.lists(text.signed(h[first]), bounds, pa.int64()), text.lists(seen.astype(np.int32), bounds, pa.int32())],
                [c.split()[0] for c in PARTS.split(", ")],
            )

    return run


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Learns from documents whose fold is not 1. A NULL or empty text is its end alone. Ids may be NULL (then never held out
    nor learned from) or repeat: one result per row. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = rows.where(linear.fold() != 1)
    path = workspace(spark, "token-counts")
    learned.mapInArrow(_count, "word long, ending int, seen long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("seen").alias("seen")).write.parquet(path)
    counts = spark.read.parquet(path)
    model = train(spark, learned, counts)
    path = workspace(spark, "scored")
    rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), PARTS).write.parquet(path)
    parts = spark.read.parquet(path)
    tail = parts.where(F.size("tail_words") > 0).select("row", F.explode(F.arrays_zip("tail_words", "tail_seen")).alias("t")).select("row", F.col("t.tail_words").alias("word"), F.col("t.tail_seen").alias("times"))
    seen = F.coalesce("seen", F.lit(0))
    sums = tail.join(counts.select("word", "seen"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(seen + 0.5)).alias("tail_log"), F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )
    whole = parts.drop("tail_words", "tail_seen").join(sums, "row", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return whole.select(
        "doc_id",
        F.coalesce(linear.fold() == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + tail_log).alias("base_score"),
        (F.col("score") + tail_log).alias("score"),
    )
