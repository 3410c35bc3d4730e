"""Token ids of words against the tokenizers library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from drayline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(texts):
    return [ids.tolist() for ids in packing.WordTokenizer(PATH).texts(pa.array(texts, pa.string()), 1)]


def odd_words():
    letters = [chr(c) for c in range(33, 0x250)]
    some = random.Random(3)
    pairs = [some.choice(letters) + c for c in letters]
    signs = ["".join(some.choices("abZ019.,*-<|'sÉéßİıǅſÿŸ", k=some.randint(1, 60))) for _ in range(2_000)]
    ascii_words = ["".join(some.choices([chr(c) for c in range(33, 127)], k=some.randint(1, 12))) for _ in range(2_000)]
    wide = ["".join(some.choices([chr(c) for c in range(0x80, 0x400)] + list("aB1*"), k=some.randint(1, 9))) for _ in range(2_000)]
    lengths = [c * n for c in "x*é" for n in (24, 25, 47, 48, 49, 300)]
    return pairs + signs + ascii_words + wide + lengths


def test_ids_of_odd_words_are_those_of_the_library(library):
    words = odd_words()
    assert ids_of(words) == [library(w) + [1] for w in words]


def test_a_special_token_in_capitals_is_a_word(library):
    texts = ["a <|STARTOFTEXT|> b", "<|EndOfText|>", "x<|endoftext|>Y"]
    assert ids_of(texts) == [library(t) + [1] for t in texts]


def test_texts_are_their_words(library, monkeypatch):
    monkeypatch.setattr(packing.texts_of, "CHUNK_BYTES", 500)
    some, words = random.Random(4), odd_words()
    texts = [None, "", " ", "\n\n a  b\r\n", " x", "x\t", "　a b \x0b\x0c c"] + [some.choice(" \n\t").join(some.choices(words, k=40)) for _ in range(100)] + ["", None]
    assert ids_of(texts) == [library(t or "") + [1] for t in texts]
    assert ids_of([]) == [] and ids_of([None, ""]) == [[1], [1]]


def test_windows_do_not_change_pieces(monkeypatch):
    texts = [" ".join(random.Random(i).choices(odd_words()[:300], k=200)) for i in range(30)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(31)), pa.array(texts, pa.string())], ["doc_id", "text"])
    whole = list(packing._pieces(64, PATH)([batch]))
    monkeypatch.setattr(packing, "TOGETHER_BYTES", 2_000)
    windows = list(packing._pieces(64, PATH)([batch]))
    assert len(windows) > len(whole) == 1
    assert pa.Table.from_batches(windows).combine_chunks().equals(pa.Table.from_batches(whole))


def test_the_library_gets_only_words_it_alone_knows(monkeypatch):
    asked = []
    real = packing.WordTokenizer._ids
    monkeypatch.setattr(packing.WordTokenizer, "_ids", lambda self, words: asked.extend(words) or real(self, words))
    ids_of(["Plain words*** (829) 555-9996 Éclair, ÉCLAIR. it's %%%done\n" * 50 + "日本"])
    assert sorted(w.strip() for w in asked) == ["it's".encode(), "日本".encode()]
