"""Places where an operator once did less than the whole job."""

import random
import textwrap

import pytest

from drayline.llm import decontamination, licenses, pii
from drayline.llm.license_texts import TEXTS


# --- Decontamination ---------------------------------------------------------------------------


@pytest.mark.parametrize("copies", [16, 17, 5000])
def test_edited_copies_are_found_however_many(spark, copies):
    item = [f"word{i}" for i in range(40)]
    edited = item.copy()
    for k in (5, 13, 21, 29):  # breaks 12 of 38 n-grams
        edited[k] = "edited"
    rng = random.Random(7)
    docs = [(i, " ".join([f"x{rng.randrange(500)}" for _ in range(9)] + edited + ["end"])) for i in range(copies)] + [(9999, "nothing of it")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontamination.contaminated(spark, frame, items).collect()
    assert sorted(r.doc_id for r in found) == list(range(copies))
    assert {(r.score, r.matched_words, r.start_word, r.end_word) for r in found} == {(68 / 80, 36, 9, 49)}


def test_copies_with_many_insertions_are_found_whole(spark):
    item = [f"word{i}" for i in range(40)]
    spread = item[:3] + [w for i, x in enumerate(item[3:]) for w in ([x, f"new{i}"] if i % 2 else [x])]
    frame = spark.createDataFrame([(1, " ".join(spread)), (2, " ".join(item[:3]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = decontamination.contaminated(spark, frame, items).collect()
    assert [(r.doc_id, r.matched_words, r.end_word) for r in found] == [(1, 40, len(spread))]


# --- Licenses ----------------------------------------------------------------------------------


def test_whole_license_texts_and_headers_are_told_apart(spark):
    names = [n for n in TEXTS if n.endswith(("-whole", "-header")) and len(TEXTS[n]) < 20_000]
    wrapped = lambda t: "\n".join(f" * {line}" for line in textwrap.wrap(t, 60))
    rows = [(i, "Copyright 2020 A. Person\n" + wrapped(TEXTS[n]) + "\nend") for i, n in enumerate(names)]
    rows += [(1000, licenses.NOTICES["BSD"]), (1001, licenses.NOTICES["MIT-text"]), (1002, "Licensed under the Apache License, Version 2.0.")]
    rows += [(1003, TEXTS["BSD-3-Clause-whole"].replace("copyright holder nor", "University nor").replace("COPYRIGHT HOLDERS AND", "REGENTS AND"))]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert sorted((r.doc_id, r.license) for r in found) == [*enumerate(names), (1000, "BSD"), (1001, "MIT-text"), (1002, "Apache-2.0"), (1003, "BSD-3-Clause-whole")]
    for r in found:
        if r.doc_id < 1000:
            assert r.coverage == 1.0 and r.end - r.start > len(TEXTS[names[r.doc_id]]) - 8 and "Copyright 2020" not in texts[r.doc_id][r.start : r.end]


# --- Personal data -----------------------------------------------------------------------------


def test_secrets_without_digits_are_found(spark):
    given = ["set password=correcthorse now", "and api_key: abcdefgh there", "then token = abcdefgh ends", "PWD: Correct!horse", "the token was lost and the secret kept"]
    rows = [(i, t) for i, t in enumerate(given)] + [(100 + i, f"key token = {'ab' * 12}{i} in volume {i} page {i} of 1999") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [s.hit for s in r.secret] for r in pii.spans(spark, df).collect()}
    assert [found[i] for i in range(5)] == [["password=correcthorse"], ["abcdefgh"], ["abcdefgh"], ["Correct!horse"], []]
    clean = {r.doc_id: r.text for r in pii.redact(spark, df).collect()}
    assert clean[2] == "then token = [secret] ends" and clean[4] == given[4]
