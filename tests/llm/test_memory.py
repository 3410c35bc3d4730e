"""Memory of the functions that run in tasks: it follows the windows, not the batch."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from drayline.llm import packing, quality


def one_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])


def traced_mb(run):
    """What is held at most when a result is given out, and at most at all."""
    tracemalloc.start()
    try:
        held = max(tracemalloc.get_traced_memory()[0] for _ in run())
        return held / 1e6, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def new_words(texts, words):
    some = random.Random(1)
    return [" ".join("".join(some.choices("abcdefghijklmnoprstu", k=9)) for _ in range(words)) for _ in range(texts)]


def test_packing_keeps_no_words_beyond_a_window():
    batch, path = one_batch(new_words(300, 1_500)), public_tokenizers.path("word_bpe_49k.json")
    packing.word_tokenizer(path)
    held, _ = traced_mb(lambda: packing._pieces(4096, path)([batch]))
    assert held < 15


def test_quality_features_are_made_of_little_text_at_once():
    batch = one_batch(new_words(200, 1_000))
    _, most = traced_mb(lambda: quality.accepted([batch], np.zeros(quality.BUCKETS, dtype=np.float32), 0.0, 0.3))
    assert most < 55


def test_accepted_rows_do_not_depend_on_windows(monkeypatch):
    batch = one_batch([*new_words(60, 100), None, ""])
    weights = np.random.default_rng(2).normal(size=quality.BUCKETS).astype(np.float32)
    whole = pa.Table.from_batches(quality.accepted([batch], weights, 0.0, 0.5))
    monkeypatch.setattr(quality.linear, "FEATURE_BYTES", 900)
    parts = list(quality.accepted([batch], weights, 0.0, 0.5))
    assert len(parts) > 1 and 0 < whole.num_rows < batch.num_rows
    assert pa.Table.from_batches(parts).combine_chunks().equals(whole.combine_chunks())
