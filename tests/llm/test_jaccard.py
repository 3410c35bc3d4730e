import random

import brute
import numpy as np
import pytest

from drayline.llm import jaccard
from drayline.llm.components import components

SCHEMA = "doc_id long, text string"


def near_copies(seed, families, most, length):
    """Families of edited copies, texts with a shared passage, exact copies, and short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocabulary, k=14)
    texts = [None, "", " \n\t", "one", "One", "one two", "a b c", "A  b\nc", "a b c d"]
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(4, length))
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                at = rng.randrange(len(copy))
                kind = rng.randrange(3)
                copy[at : at + (kind != 1)] = [] if kind == 0 and len(copy) > 1 else [rng.choice(vocabulary)]
            texts.append(" ".join(copy))
            if rng.random() < 0.2:
                texts.append(" ".join(copy).upper())
    for _ in range(60):
        texts.append(" ".join(passage + rng.choices(vocabulary, k=rng.randint(1, 9))))
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed, families, most, length, percent, n", [(1, 40, 6, 120, 90, 3), (2, 3, 90, 150, 90, 3), (3, 3, 80, 60, 80, 5), (4, 60, 4, 25, 80, 5)])
def test_links_are_those_of_brute_force(spark, seed, families, most, length, percent, n):
    docs = near_copies(seed, families, most, length)
    found = jaccard.linked_documents(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), percent, n)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.linked(docs, percent, n)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w"), (2, "a b c d e f"), (7, None), (8, "x y z u v w")]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, n long, component_id string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_documents(spark, df, 90, 3).collect()), key=repr)
    assert found == sorted([(None, 4, None), (1, 4, 1), (1, 4, 1), (2, 4, 1), (2, 4, 1), (7, 0, 7), (8, 4, 1)], key=repr)
    assert jaccard.linked_documents(spark, df.limit(0), 90, 3).count() == 0
    kept = jaccard.one_of_each(spark, df, 90, 3)
    # Each row is judged by its own text: one of each of the two texts stays, and what has no words.
    assert kept.columns == df.columns
    kept = kept.collect()
    assert sorted((r.text for r in kept), key=repr) == sorted(["a b c d e f", "x y z u v w", None], key=repr)
    assert all((r.doc_id, r.text) in rows for r in kept)


def test_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_beyond_the_threshold_are_not_paired(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(149)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(0, 149, 5), 5):
            copy[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    line = base[:30]
    texts += [" ".join(line + [f"y{rng.randrange(10**9)}" for _ in range(rng.randint(5, 60))]) for _ in range(80)]
    docs = list(enumerate(texts, 1))
    looked_up = []
    possible = jaccard.Join.possible

    def counted(self, pairs):
        looked_up.append(pairs.count())
        return possible(self, pairs)

    monkeypatch.setattr(jaccard.Join, "possible", counted)
    found = jaccard.linked_documents(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), 80, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.linked(docs, 80, 5)
    assert looked_up[-1] < 500  # of 7140 pairs within the family


def test_spared_cells_lose_no_pair():
    rng = random.Random(8)
    threshold = jaccard.Threshold(80, 100, 5)
    cells = jaccard.Cells(threshold)
    sets = []
    for size in (4, 9, 30, 31, 80, 200, 420):
        base = [rng.getrandbits(63) for _ in range(size)]
        for edits in range(0, size // 8 + 1, max(1, size // 40)):
            for added in {edits, 2 * edits, 0}:
                sets.append(set(rng.sample(base, size - edits)) | {rng.getrandbits(63) for _ in range(added)})
    placed = []
    for one in sets:
        found, spare = cells.of(np.sort(np.array(list(one), dtype=np.uint64)))
        groups: dict = {}
        for cell, most in zip(found.tolist(), spare.tolist()):
            groups.setdefault((cell & 1, most), []).append(cell)
        # any order that is the same for all sets: here that of the numbers
        placed.append({c for (_, most), g in groups.items() for c in sorted(g)[: len(g) - most]})
        assert sum(most for _, most in groups if most) > 0 or len(one) < 10
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(pairs) > 50
    assert all(placed[a] & placed[b] for a, b in pairs)


def one_family(seed, many):
    """Copies of one text with few to many edits each: unrelated edits, so that a pair is as far apart as both are from the text."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(many):
        copy = list(base)
        for at in rng.sample(range(300), 2 + 28 * i // many):
            copy[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_documents_far_from_the_middle_of_a_region_are_not_met(spark, monkeypatch):
    docs = list(enumerate(one_family(9, 160), 1))
    met = []
    inner_pairs = jaccard.Join.inner_pairs

    def counted(self, prefixes):
        with monkeypatch.context() as every:
            every.setattr(type(prefixes), "distinct", lambda df: df)
            met.append(inner_pairs(self, prefixes).count())
        return inner_pairs(self, prefixes)

    monkeypatch.setattr(jaccard.Join, "inner_pairs", counted)
    found = jaccard.linked_documents(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), 80, 5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.linked(docs, 80, 5)
    assert 0 < met[0] < 500  # of 12720 pairs within the family


def test_large_regions_with_several_texts_an_id(spark):
    texts = one_family(10, 70) + one_family(11, 70) + [f"{a} {b}" for a, b in zip(one_family(12, 40), one_family(10, 40))]
    # The texts with the fewest edits, which become pivots, share ids with others.
    rows = [(i % 90, t) for i, t in enumerate(texts)]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, (_, same) in brute.linked(list(enumerate(texts)), 80, 5).items():
        a, b = root(rows[at][0]), root(rows[same][0])
        parent[max(a, b)] = min(a, b)
    found = jaccard.linked_documents(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), 80, 5).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, root(i)) for i in parent} and len(found) == len(rows)
