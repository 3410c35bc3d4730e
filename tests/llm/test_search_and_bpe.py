"""Clustering, ranked search and byte-level BPE against plain versions and the tokenizers library, and with odd rows."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import documents, odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drayline.llm import bpe, clustering, lexical

# --- Clustering --------------------------------------------------------------------------------


def plain_clusters(rows, clusters, rounds, dimensions, scale=1024):
    """Sorted (vec_id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    return sorted(((i, n, d) for i, v in kept for d, n in [nearest(v)]), key=repr), centroids


def clustered(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("own"), "distance": F.lit(1)})
    assigned, centroids = clustering.cluster(spark, frame, **how)
    return sorted(((r.vec_id, r.cluster, r.distance) for r in assigned.collect()), key=repr), centroids.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_plain_rounds(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 7)
    rows = [(i, [rng.choice([-0.5, -0.001, 0.0, 0.0009, 0.25, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(150)]
    rows += [(rows[0][0], rows[0][1]), (rows[1][0], rows[2][1]), (None, [0.1] * 4)]  # repeated rows and ids, no id
    odd = [(900, None), (901, []), (902, [0.0] * 3), (903, [0.0] * 5), (904, [0.0, None, 0.0, 0.0]), (905, [float("nan")] * 4), (906, [0.0, 0.0, float("-inf"), 1.0])]
    assert clustered(spark, rows + odd, clusters=5, rounds=4, dimensions=4) == plain_clusters(rows + odd, 5, 4, 4)


def test_equal_vectors_leave_clusters_empty_and_in_place(spark):
    rows = [(i, [0.5, -0.5]) for i in range(20)] + [(100, [9.0, 9.0])]
    got = clustered(spark, rows, clusters=4, rounds=3, dimensions=2)
    assert got == plain_clusters(rows, 4, 3, 2)


def test_few_and_no_vectors(spark):
    assert clustered(spark, [(1, [1.0, 2.0])], clusters=8, rounds=2, dimensions=2) == ([(1, 0, 0)], [[1024, 2048]])
    assigned, centroids = clustering.cluster(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert clustering.with_inertia(spark, assigned, centroids).collect() == []


def test_inertia_and_centroid_hash(spark):
    rows = [(i, [i / 8.0, -i / 8.0]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = clustering.with_inertia(spark, *clustering.cluster(spark, frame, clusters=3, rounds=2, dimensions=2)).collect()
    want, centroids = plain_clusters(rows, 3, 2, 2)
    per = Counter()
    for _, n, d in want:
        per[n] += d
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (per[r.cluster], sum(per.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_distances_beyond_64_bits_are_an_error(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 0.0])]
    with pytest.raises(Exception, match="64 bits"):
        clustered(spark, rows, clusters=2, rounds=1, dimensions=2)


# --- Ranked search -----------------------------------------------------------------------------


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranking(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(1), "score": F.lit("own"), "terms": F.lit("x")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(0), "item_row": F.lit(5)})
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank(spark, d, i, k, **how).collect()), key=repr)


@pytest.mark.parametrize("block_terms", [1_000_000, 40])
def test_ranking_equals_scoring_all(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "CHUNK_DOCUMENTS", 60)
    docs = documents(200) + odd_documents()
    items = [(i, t) for i, t in documents(12)] + [(50, None), (51, ""), (52, "?!"), (0, "same id again the la"), (53, "nowhere-to-be-found")]
    assert ranked(spark, docs, items, 7, block_terms=block_terms) == plain_ranking(docs, items, 7)


def test_ties_fall_to_the_smaller_id(spark):
    docs = [(i, "alpha beta") for i in (5, 3, 9, 3, None, 1)] + [(2, "gamma"), (4, "beta gamma delta")]
    got = ranked(spark, docs, [(1, "Alpha ALPHA beta"), (2, "delta")], 4)
    assert got == plain_ranking(docs, [(1, "Alpha ALPHA beta"), (2, "delta")], 4)
    assert [r[2] for r in got if r[0] == 1] == [1, 3, 3, 5]


def test_ranking_of_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")], 5) == []
    assert ranked(spark, [(1, "a")], [], 5) == []


def test_the_walk_leaves_subtrees_out():
    import pyarrow as pa

    rng = random.Random(3)
    docs = [(i, " ".join(["common"] * rng.randrange(1, 4) + rng.sample([f"w{j}" for j in range(40)], 12) + (["rare"] if i % 400 == 0 else []))) for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    item = pa.RecordBatch.from_pydict({"item_row": [0], "item_id": [0], "text": ["common rare w1 w2 w3 w4"]})
    hashes = next(lexical._item_terms([item])).column(2)[0].as_py()
    vocabulary = np.unique(np.array(hashes, dtype=np.int64).view(np.uint64))
    vectors = list(lexical._vectors(vocabulary)([batch]))
    holding = np.bincount(np.concatenate([v.column(2).flatten().to_numpy() for v in vectors]))
    weights = np.array([lexical.weight(2000, int(h)) for h in holding])
    chunk = lexical.Chunk(vectors, 2000, sum(len(terms(t)) for _, t in docs), len(vocabulary))
    trie, best = lexical.Trie(chunk, np.argsort(-holding).tolist(), weights), lexical.Best(5)
    visited = lexical.search(trie, best)
    assert sorted(best.doc_id.tolist()) == [0, 400, 800, 1200, 1600]
    assert visited < len(trie.parent)
    assert not chunk.node_of.any()


# --- Byte-level BPE ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def machine():
    return bpe.Transducer(bpe.read_vocabulary(bpe.default_vocabulary()), bpe.unknown_characters())


PARTS = ["a", "b", "the", "é", "ñ", " ", "  ", "\n", "\t", "'", "'s", "'re", "'v", "1", "23", "!", "...", "<|endoftext|>", "<|endof", " ", "　", "漢", "字", "🙂", "\x00", "\x85", "‍", "౜", "e" * 40, " " * 70, "=-" * 30, "ab" * 500]


def encoded(machine, *several):
    return [np.frombuffer(x, dtype="<i4").tolist() for x in machine.encode(list(several), bpe.PieceCache(machine))]


@pytest.mark.parametrize("window", [8, 16, 64, 1 << 15])
def test_any_window_gives_the_librarys_ids(library, machine, monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    monkeypatch.setattr(bpe, "HELD", 300)
    rng = random.Random(window)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(150)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(machine, *texts) == want
    for ids in want:
        assert "".join(machine.decode(np.array(ids, dtype=np.int32))) == library.decode(ids, skip_special_tokens=False)


def test_long_pieces_are_merged_as_they_arrive(library, machine):
    rng = random.Random(1)
    long = ["é" * 40_000, "a" * 70_000, " " * 70_001 + "x", "\n" * 40_000, "!?" * 40_000, "7" * 40_000, "".join(rng.choice("etaoinshrdlu") for _ in range(70_000))]
    assert encoded(machine, *long) == [e.ids for e in library.encode_batch(long, add_special_tokens=False)]


def test_what_is_emitted_never_changes(machine):
    """Any continuation keeps the tokens that end a lookahead before the end of the beginning."""
    rng = random.Random(7)
    pool = [t for t in machine.bytes_of if 1 < len(t) < 12]
    for _ in range(40):
        data = b"".join(rng.choice(pool) for _ in range(600))
        ids = machine.merged(data)
        cut = rng.randrange(machine.lookahead, len(data))
        assert list(machine.stream([data[i : i + 100] for i in range(0, len(data), 100)])) == ids
        ends = set(np.cumsum([len(machine.bytes_of[i]) for i in ids]).tolist())
        early = set(np.cumsum([len(machine.bytes_of[i]) for i in machine.merged(data[:cut])]).tolist())
        limit = cut - machine.lookahead
        assert {e for e in ends if e < limit} == {e for e in early if e < limit}


def test_merges_without_origin_are_refused():
    vocabulary = {c: i for i, c in enumerate([*bpe.byte_characters(), "ab", "abc"])}
    with pytest.raises(ValueError, match="earlier merge"):
        bpe.Transducer(json.dumps({"added_tokens": [], "model": {"vocab": vocabulary, "merges": [["ab", "c"]]}}), "")


def test_character_classes_of_every_code_point(library, machine):
    pre = library.pre_tokenizer
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 5000):
        text = "".join(f"a{c}1{c}{c} {c}!" for c in points[at : at + 5000])
        assert machine.pieces.findall(text) == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]


def test_bytes_that_are_no_text(library, machine):
    ids = [random.Random(2).randrange(50257) for _ in range(100_000)]
    assert "".join(machine.decode(np.array(ids))) == library.decode(ids, skip_special_tokens=False)
    assert "".join(machine.decode(np.array([-1, 50256, 99_999]))) == "<|endoftext|>"


def test_round_trip_of_documents(spark, library):
    rows = documents(150) + odd_documents() + [(7_000_000, "a <|endoftext|> b"), (7_000_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("own"), "n_tokens": F.lit(0)})
    got = bpe.digest(bpe.decode(bpe.encode(frame))).collect()

    def digest(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        return (i, len(ids), *sha)

    assert sorted((tuple(r) for r in got), key=repr) == sorted((digest(*r) for r in rows), key=repr)
    assert bpe.digest(bpe.decode(bpe.encode(frame.limit(0)))).collect() == []
    with pytest.raises(ValueError, match="text already"):
        bpe.decode(frame)
