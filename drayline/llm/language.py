"""Language identification, words first: a known word counts with its log frequency in each language; a word unseen in
training falls back to its character 5-grams, then 4-, 3-, 2- and 1-grams, until one length is known."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drayline.llm import linear

WORD = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 5
LONGEST_WORD = 60  # longer runs of letters are scored by the grams of all of their parts of this length
CACHE_WORDS = 150_000
UNKNOWN = "und"


@dataclass
class Model:
    """Log frequencies: ``words`` and ``grams[n]`` map to rows of a matrix with one column per language."""

    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    table: np.ndarray
    default: np.ndarray


def letters_only(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, w[i : i + LONGEST_WORD]) for w in letters_only(text) for i in range(0, len(w), LONGEST_WORD))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "seen"])


def train(labelled: DataFrame, sample_rows: int = 4_000, known_words: int = 60_000, known_grams: int = 30_000) -> Model:
    """Learn from at most about ``sample_rows`` rows (doc_id, text, lang) of each language.

    The ``known_words`` most frequent words of the sample that occur at least twice are kept, and as many grams of each
    length, so the model's size is bounded by these parameters and the number of languages.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes, key=lambda k: (-sizes[k], k))
    if not languages:
        return Model([], {}, [{} for _ in range(LONGEST_GRAM + 1)], np.zeros((0, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, int(1e6 * min(1.0, sample_rows / sizes[k])) )])
    sample = rows.where(F.expr("pmod(xxhash64(doc_id, 17), 1000000)") < share[F.col("lang")])
    counted = sample.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, seen long").groupBy("lang", "word").agg(F.sum("seen").alias("seen"))
    by_word = counted.withColumn("all", F.sum("seen").over(Window.partitionBy("word"))).where("all >= 2")
    found = by_word.orderBy(F.desc("all"), "word", "lang").limit(known_words * 2).toArrow().to_pylist()
    column = {k: i for i, k in enumerate(languages)}
    words: dict[str, int] = {}
    grams: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
    gram_counts: list[Counter] = [Counter() for _ in range(LONGEST_GRAM + 1)]
    word_counts: Counter = Counter()
    for r in found:
        if r["word"] not in words:
            if len(words) >= known_words:
                continue
            words[r["word"]] = len(words)
        word_counts[r["word"], r["lang"]] += r["seen"]
        marked = f"_{r['word']}_"
        for n in range(1, LONGEST_GRAM + 1):
            for i in range(len(marked) - n + 1):
                gram_counts[n][marked[i : i + n], r["lang"]] += r["seen"]
    size = len(words)
    for n in range(1, LONGEST_GRAM + 1):
        totals: Counter = Counter()
        for (gram, _), c in gram_counts[n].items():
            totals[gram] += c
        for gram, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:known_grams]:
            grams[n][gram] = size
            size += 1
    seen = np.zeros((size, len(languages)))
    for (word, lang), c in word_counts.items():
        seen[words[word], column[lang]] = c
    for n in range(1, LONGEST_GRAM + 1):
        for (gram, lang), c in gram_counts[n].items():
            if gram in grams[n]:
                seen[grams[n][gram], column[lang]] += c
    table = np.zeros_like(seen)
    for rows_of in (list(words.values()), *[list(g.values()) for g in grams[1:]]):
        if rows_of:
            part = seen[rows_of]
            table[rows_of] = np.log((part + 0.05) / (part.sum(axis=0) + 0.05 * len(rows_of) + 1e-9))
    return Model(languages, words, grams, table.astype(np.float32), np.log(np.array([sizes[k] for k in languages]) / sum(sizes.values())).astype(np.float32))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}

    def word(self, word: str) -> np.ndarray:
        m = self.model
        known = m.words.get(word)
        if known is not None:
            return m.table[known]
        found = self.cache.get(word)
        if found is None:
            found = self._back_off(word)
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            if len(word) <= LONGEST_WORD:
                self.cache[word] = found
        return found

    def _back_off(self, word: str) -> np.ndarray:
        marked = f"_{word}_"
        for n in range(LONGEST_GRAM, 0, -1):
            known = self.model.grams[n]
            rows = [k for k in (known.get(marked[i : i + n]) for i in range(len(marked) - n + 1)) if k is not None]
            if rows:
                return self.model.table[rows].mean(axis=0)
        return np.zeros_like(self.model.default)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(letters_only(text or ""))
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        each = np.stack([self.word(w) for w in counts])
        total = np.array(list(counts.values()), dtype=np.float64) @ each + self.model.default
        best = int(np.argmax(total))
        return self.model.languages[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1, the likelihood of the language among those learned) of every whole text.

    A NULL text or one without a letter is ``und`` with score 0, as is every text when nothing could be learned. Ties go to
    the language with more training rows. Ids may be NULL or repeat: one result per row. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(v.as_py()) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where(linear.fold() != 0)
