"""Every stage of the pipeline on its own input, against plain versions."""

import re

import brute
import pytest
from conftest_llm import odd_documents
from pyspark.sql import functions as F

import corpus_pipeline
from drayline.llm import quality, registry

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]


def test_quality_stage(spark, docs):
    kept = STAGES["quality classifier"](spark, docs, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scored = quality.score(docs, quality.train(quality.labelled_documents(docs, labels, "quality")))
    assert rows(kept) == rows(docs.join(scored.where("predicted = 1").select("doc_id"), "doc_id").select(docs.columns))
    assert 0 < kept.count() < docs.count() and kept.columns == docs.columns


def test_near_copy_stage(spark, docs):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = {i for i, (_, component) in brute.linked(pairs, 80, 5).items() if i == component}
    kept = STAGES["n-gram Jaccard join"](spark, docs, SMALL)
    assert rows(kept) == rows(docs.where(F.col("doc_id").isin(wanted))) and len(wanted) < docs.count()


def test_decontamination_stage(spark, docs):
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    short = docs.where("length(text) < 1500")
    wanted = set()
    for r in short.collect():
        words = plain(r.text)
        if all(brute.smith_waterman(i, words) < i.__len__() for i in items):
            wanted.add(r.doc_id)
    kept = STAGES["benchmark decontamination"](spark, short, SMALL)
    assert {r.doc_id for r in kept.collect()} == wanted


def test_personal_data_stage(spark, docs):
    out = {r.doc_id: r for r in STAGES["PII"](spark, docs, SMALL).collect()}
    for r in docs.collect():
        text = out[r.doc_id].text
        assert brute.personal(text)[:4] == (0, 0, 0, 0) and out[r.doc_id].n_chars == len(text)
        assert (out[r.doc_id].lang, out[r.doc_id].source) == (r.lang, r.source)
        if not re.search("[0-9@]", r.text):
            assert text == r.text


def test_whole_pipeline_and_odd_rows(spark, tmp_path):
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.count() >= whole.select("doc_id").distinct().count() > 0
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    odd = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in odd_documents()], "doc_id long, text string, lang string, source string, n_chars long")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.where("doc_id is null").count() >= 1
    odd.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


SCHEMA = "doc_id long, text string, n_chars long, pii_email string, pii_text int, row string, shared boolean, found long"


def strange(spark, texts):
    """Rows whose other columns have the names of working columns."""
    return spark.createDataFrame([(i, t, None if t is None else len(t), "own", 7, "r", True, 3) for i, t in texts], SCHEMA)


def test_rows_that_share_an_id_are_judged_by_themselves(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    docs = strange(spark, [(1, a), (1, b), (1, b), (2, a + " end"), (3, c), (None, c + " end"), (None, None), (4, None), (5, a)])
    kept = rows(STAGES["n-gram Jaccard join"](spark, docs, SMALL).select("doc_id", "text"))
    assert [t for _, t in kept].count(b) == 1 and sum((t or "").startswith("a0") for _, t in kept) == 1 and sum((t or "").startswith("c0") for _, t in kept) == 1
    assert (4, None) in kept and (None, None) in kept and len(kept) == 5


def test_contaminated_rows_go_whatever_their_id(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    docs = strange(spark, [(1, "before " + item + " after"), (1, "clean words only here"), (None, item), (None, "clean too"), (2, None), (2, "")])
    kept = STAGES["benchmark decontamination"](spark, docs, SMALL)
    assert kept.schema == docs.schema
    assert rows(kept.select("doc_id", "text")) == sorted([(1, "clean words only here"), (None, "clean too"), (2, None), (2, "")], key=repr)


def test_columns_named_like_working_columns_stay(spark):
    docs = strange(spark, [(1, "mail a.b@example.com now"), (2, None), (None, "nothing")])
    out = STAGES["PII"](spark, docs, SMALL)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert {r.text for r in out.collect()} == {"mail [email] now", None, "nothing"}
    for r in out.collect():
        assert (r.pii_email, r.pii_text, r.row, r.shared, r.found) == ("own", 7, "r", True, 3)


def test_without_an_id_nothing_is_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "some text", "en", "s", 9), (3, "other text", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op2_toxicity", "op9_language_id", "op10_quality"):
        found = {r.doc_id: r.held_out for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert found[None] is False and found[3] is not None
