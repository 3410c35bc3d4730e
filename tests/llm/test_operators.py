"""The other operators against plain versions, exact round trips and held-out accuracy, and with odd rows."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import documents, odd_documents
from pyspark.sql import functions as F

from drayline.llm import align, decontamination, hamming, language, licenses, linear, maxent, packing, pii, quality, registry, text, toxicity

SMALL = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- Words and hashes --------------------------------------------------------------------------


def test_hashes_follow_words():
    rng = random.Random(1)
    texts = [None, "", "a", "  a b ", "A b", "x y z x y z", "É é a b"] + ["".join(rng.choice(" \nabAé\t") for _ in range(rng.randrange(60))) for _ in range(300)]
    w = text.words(pa.array(["before", *texts]).slice(1))
    for n in (1, 2, 3, 5):
        values, bounds = text.shingle_sets(w, n)
        seen = {}
        for i, t in enumerate(texts):
            found = frozenset(values[bounds[i] : bounds[i + 1]].tolist())
            assert len(found) == len(brute.shingles(t, n))
            assert seen.setdefault(brute.shingles(t, n), found) == found
        assert len(set(seen.values())) == len(seen)


# --- Packing -----------------------------------------------------------------------------------


def check_plan(counts, capacity):
    placed, sequences = packing.packing_plan(counts, capacity)
    filled, numbers = {}, {}
    for length, lo, hi, first, offset in placed:
        numbers.setdefault(length, []).append((lo, hi))
        for i in range(hi - lo):
            filled.setdefault(first + i, []).append((offset, length))
    for length, count in counts.items():
        spans = sorted(numbers[length])
        assert spans[0][0] == 0 and spans[-1][1] == count and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(filled) == sequences
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_plans():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randrange(1, 40)
        check_plan({rng.randrange(1, capacity + 1): rng.randrange(1, 30) for _ in range(rng.randrange(1, 20))}, capacity)
    assert check_plan({}, 10) == 0
    assert check_plan({7: 3, 3: 3}, 10) == 3
    assert check_plan({6: 4, 4: 4}, 10) == 4 and check_plan({10: 5}, 10) == 5 and check_plan({1: 100}, 10) == 10
    for seed in range(20):  # large pieces only: as few sequences as an exact matching gives
        rng = random.Random(seed)
        sizes = [rng.randint(11, 30) for _ in range(9)]
        counts = {s: sizes.count(s) for s in sizes}
        assert check_plan(counts, 30) == len(sizes) - most_pairs(tuple(sorted(sizes)), 30)


def most_pairs(sizes, capacity):
    if len(sizes) < 2:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = most_pairs(rest, capacity)
    for i, other in enumerate(rest):
        if first + other <= capacity:
            best = max(best, 1 + most_pairs(rest[:i] + rest[i + 1 :], capacity))
    return best


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(7)
    rows = [(i, t) for i, t in documents(60)] + odd_documents()
    rows += [(5000 + i, "".join(rng.choice(list("aB ,.'\n\t\r\x1c é́Σs1!İ²-<|>ß")) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(9000, "<|endoftext|>, x <|startoftext|>"), (9001, "it's, A.B")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, piece int, start string")
    out = packing.pack(spark, df, capacity=64).collect()
    tokenizer = Tokenizer.from_file(path)
    wanted = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            wanted.append((i, piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(wanted, key=repr)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 64
    assert packing.pack(spark, df.limit(0)).count() == 0


# --- Personal data -----------------------------------------------------------------------------


def test_personal_data_as_the_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["a", "b.", "@", "-", "+1", " ", "1", "2 ", "25", "5.", "(", "é😀", "_%", "4111111111111111", "4111-1111 1111-1111", "."]
    texts = [None, "", "a@b.c", "a@b.com_x@y.org, x@a..b z@b.c. q@-.--", "12345.1.1.1 1.2.3.4.5 0001.02.3.255.", "+1 (555) 555-1234"]
    texts += ["x" * 20000, "1" * 20000, "1-" * 9000, "a@" + "b." * 9000 + "c", "+" + "1." * 9000, "1.1.1.1 " * 300, "+1 555 555 1234, " * 200]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, email int")
    found = by_id(pii.digest(pii.spans(spark, df)))
    for i, t in enumerate(texts):
        assert tuple(found[i])[1:6] == brute.personal(t), t[:80]
    assert pii.digest(pii.spans(spark, df.limit(0))).count() == 0
    assert pii.redact(spark, df.limit(0)).columns == df.columns


def test_learned_spans_and_redaction(spark):
    rows = [(i, f"und die a{i}@mail.example.com haus password=abcdef0123456789{i} version 2.0 in 1999.") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "nichts"), (103, 'the token = "1beb58b8af68854f0e01b4ad40cdbb6a" x 7')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(pii.spans(spark, df))
    assert [s.hit for s in found[3].secret] == ["password=abcdef01234567893"] and found[103].secret
    clean = {r.doc_id: r.text for r in pii.redact(spark, df).collect()}
    assert clean[3] == "und die [email] haus [secret] version 2.0 in 1999."
    assert clean[100] is None and clean[101] == "" and clean[102] == "nichts"


# --- Alignment, decontamination, licenses ------------------------------------------------------


def test_alignment_scores():
    rng = random.Random(2)
    for _ in range(200):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(12))])
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(15))])
        best = brute.smith_waterman(a.tolist(), b.tolist())
        whole = align.smith_waterman(a, b)
        assert whole.score == best
        assert align.banded(a, b, 0, 20).score == best
        assert align.banded(a, b, 3, 2).score <= best
        if best:
            assert brute.smith_waterman(a[whole.a_start : whole.a_end].tolist(), b[whole.b_start : whole.b_end].tolist()) == best
            assert whole.matched <= min(whole.a_end - whole.a_start, whole.b_end - whole.b_start)


def test_decontamination_as_all_alignments(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}{c}" for a in "kmnst" for b in "aeiou" for c in "lrxz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 40)))) for i in range(12)] + [(50, None), (51, ""), (None, "a b c"), (52, "tal tal")]
    docs = []
    for i in range(120):
        body = rng.choices(vocabulary, k=rng.randint(0, 150))
        if i % 3 == 0:
            item = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(4)):
                item[rng.randrange(len(item))] = "edited"
            at = rng.randrange(len(body) + 1)
            body[at:at] = item if i % 2 else [w.upper() + "," for w in item]
        docs.append((i, " ".join(body)))
    docs += odd_documents()
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(spark, spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    import re

    plain = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    wanted = {}
    for i, t in docs[:120]:
        for j, item in items[:12]:
            score = brute.smith_waterman(plain(item), plain(t)) / (2 * len(plain(item)))
            if score >= 0.5:
                wanted[i, j] = score
    assert found == pytest.approx(wanted)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = decontamination.clean(spark, frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == len(docs) - len({i for i, _ in wanted})
    none = decontamination.contaminated(spark, frame, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == 0 and decontamination.contaminated(spark, frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_license_spans(spark):
    rows = [(1, "é é text. Licensed under the APACHE  License, version 2.0! more"), (2, "released under the MIT licence. x"), (3, "Licensed under the"), (4, None), (5, ""), (None, "Released under the MIT License.")]
    rows += [(6, "Released under the MIT License.\nwords between them\nReleased under the MIT License.")]
    found = sorted(((r.doc_id, r.license, round(r.coverage, 2), r.start, r.end) for r in licenses.scan(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license string")).collect()), key=repr)
    texts = dict(rows)
    assert [texts[i][a:b] for i, n, c, a, b in found if i == 1] == ["Licensed under the APACHE  License, version 2.0"]
    assert [(i, n) for i, n, *_ in found] == [(1, "Apache-2.0"), (2, "MIT"), (6, "MIT"), (6, "MIT"), (None, "MIT")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- Search ------------------------------------------------------------------------------------


def test_top_k_as_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in rng.normal(size=20)]) for i in range(150)]
    vectors += [(200 + i, vectors[0][1]) for i in range(40)] + [(300, None), (None, vectors[1][1]), (301, []), (302, [1.0, None, -1.0]), (303, vectors[5][1]), (303, vectors[5][1])]
    df = spark.createDataFrame([(*v, 1, "s") for v in vectors], "vec_id long, embedding array<double>, rank int, code string")
    queries = df.where("vec_id % 10 = 0")
    found = {}
    for r in hamming.top_k(spark, df, queries, k=5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    code = {i: np.array([(v[k] or 0) > 0 if k < len(v) else False for k in range(20)]) for i, v in vectors if i is not None and v is not None}
    assert set(found) == {i for i in code if i % 10 == 0}
    for q in found:
        near = sorted((int((code[q] != c).sum()), i) for i, c in code.items() if i != q)[:5]
        assert sorted(found[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(near)]
    others = spark.createDataFrame([(7, [1.0] * 20), (8, [1.0] * 20)], "vec_id long, embedding array<double>")
    assert hamming.top_k(spark, others, others, k=5).count() == 2
    assert hamming.top_k(spark, df.limit(0), queries.limit(0), k=5).count() == 0


# --- Models ------------------------------------------------------------------------------------


def test_base_scores_and_a_better_model(spark):
    rows = documents(300) + [(7001, ""), (7002, None), (7003, "the the unseenword"), (7003, "repeated id")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    out = maxent.score(spark, df.where("doc_id <> 7003")).collect()
    wanted = brute.base_scores([r for r in rows if r[0] != 7003])
    assert len(out) == len(wanted)
    for r in out:
        held, n, known, total, base = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert maxent.score(spark, df).where("doc_id = 7003").count() == 2
    assert maxent.score(spark, df.limit(0)).count() == 0


def test_language_model_is_a_distribution(spark):
    """Class likelihoods sum to 1 over classes, and token shares to 1 over the tokens of each class and the unseen one."""
    df = spark.createDataFrame(documents(80), "doc_id long, text string")
    counts = df.mapInArrow(maxent._count, "word long, ending int, seen long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("seen").alias("seen"))
    counts = counts.persist()
    model = maxent.train(spark, df, counts)
    t = maxent.tokens(pa.array([documents(80)[3][1]]))
    at, kind = model.classes(t)
    assert np.allclose(np.exp(model.log_likelihoods(model.features(t, kind))).sum(axis=1), 1, atol=1e-4)
    v = model.vocabulary
    endings = {r.word: r.ending for r in counts.collect()}
    share = np.zeros(maxent.CLASSES)
    for word, seen, head in zip(text.signed(v.words).tolist(), v.seen, v.head):
        share[model.head_class[head] if head >= 0 else model.ending_class[endings[word]]] += seen + 0.5
    share[maxent.HEAD_CLASSES : maxent.CLASSES - 1] += 0.5
    used = share > 0.6
    assert np.allclose(share[used], model.mass[used])
    counts.unpersist()


def test_languages_held_out(spark):
    out = registry.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = out.where("held_out").join(docs, "doc_id")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert out.count() == docs.count() and out.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([(i, t, lang) for i in range(20) for t, lang in (("der hund und die katze", "de"), ("the dog and the cat", "en"))] + [(1, None, "de"), (2, "x", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "DER HUND"), (None, "the cat"), (5, "hundkatzeundhund"), (6, "ж" * 9000)]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame([(*r, "zz") for r in rows], "doc_id long, text string, lang string"), model).collect()}
    assert [found[i][0] for i in (1, 2, 3)] == ["und"] * 3 and found[4][0] == "de" and found[None][0] == "en" and found[5][0] == "de"
    assert 0 <= found[6][1] <= 1 and found[6][0] in ("de", "en")
    empty = language.train(train.limit(0))
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), empty).collect()} == {"und"}


@pytest.mark.parametrize("name, column", [("op10_quality", "predicted"), ("op2_toxicity", "toxic")])
def test_classifiers_held_out(spark, name, column):
    out = registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    label = "quality" if name == "op10_quality" else "toxic"
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col(label).alias("wanted"))
    held = out.where("held_out").join(labels, "doc_id")
    assert held.where(F.col(column) == F.col("wanted")).count() >= 0.9 * held.count()
    assert out.count() == 1000


def test_classifiers_with_odd_rows(spark):
    rows = spark.createDataFrame(odd_documents() + odd_documents(), "doc_id long, text string").withColumn("score", F.lit("x"))
    nothing = spark.createDataFrame([], "doc_id long, text string, label int")
    some = spark.createDataFrame([(i, "fine words here" if i % 2 else "BAD!! BAD!! BAD!!", i % 2) for i in range(40)] + [(99, None, 1), (98, "x", None)], "doc_id long, text string, label int")
    for labelled in (nothing, some):
        scored = quality.score(rows, quality.train(labelled)).collect()
        assert len(scored) == rows.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
        graded = toxicity.score(rows, toxicity.train(labelled)).collect()
        assert len(graded) == rows.count() and all(0 <= r.severity <= 2 for r in graded)
    model = quality.train(some)
    kept = quality.keep_accepted(some, model)
    assert kept.columns == some.columns and kept.where("label = 0").count() == 0 and kept.where("doc_id % 2 = 1 and doc_id < 40").count() == 20
    assert quality.score(rows.limit(0), model).count() == 0


def test_fold():
    assert brute.fold(12345) == zlib.crc32(b"12345") % 5


def test_ftrl_learns():
    rng = np.random.default_rng(1)
    model = linear.Ftrl(4, alpha=0.5, l1=0.01)
    for _ in range(3000):
        x = rng.normal(size=3)
        y = float(x[0] - 2 * x[2] > 0)
        at = np.arange(3)
        w = model.weights(at)
        model.update(at, w, (linear.sigmoid(float(w @ x)) - y) * x)
    w = model.weights()
    assert w[0] > 0.5 and w[2] < -1 and abs(w[1]) < 0.5 and w[3] == 0
