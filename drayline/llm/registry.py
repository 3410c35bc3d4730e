"""The registered queries of this subpackage: each operator on its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drayline.llm import bpe, clustering, decontamination, hamming, jaccard, language, lexical, licenses, linear, maxent, packing, pii, quality, toxicity
from drayline.session import distribute_package, table_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    distribute_package(spark)
    return spark.read.parquet(table_path(sf, name))


def held_out() -> Column:
    """Fold 0 of five; a row without an id is in none."""
    return F.coalesce(linear.fold() == 0, F.lit(False))


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf, "documents"), capacity=4096)


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.train(quality.labelled_documents(docs, table(spark, sf, "labels"), "toxic"))
    return toxicity.score(docs, model).withColumn("held_out", held_out())


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.spans(spark, table(spark, sf, "documents")))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_hamming_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return hamming.top_k(spark, vectors, vectors.where("vec_id % 50 = 0"), k=10)


def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.linked_documents(spark, table(spark, sf, "documents"), similarity_percent=90, words=3)


def op8_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return maxent.score(spark, table(spark, sf, "documents"))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.identify(docs, language.train(language.training_rows(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = quality.train(quality.labelled_documents(docs, table(spark, sf, "labels"), "quality"))
    return quality.score(docs, model, threshold=0.3).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.with_inertia(spark, *clustering.cluster(spark, table(spark, sf, "embeddings")))


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank(spark, table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


def op13_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf, "documents"))))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_hamming_top_k": op5_hamming_top_k,
    "op6_license_scan": op6_license_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_lexical_search": op12_lexical_search,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}
def clustering_sql(clusters: int = 8, rounds: int = 10, scale: int = 1024, dimensions: int = 64) -> str:
    """The same rounds as a chain of common table expressions."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), v) <= {clusters})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
            SELECT n, vec_id, v, c, d FROM (
                SELECT k.n, k.vec_id, k.v, z.c, list_sum(list_transform(list_zip(k.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
                FROM kept k CROSS JOIN c{r} z)
            QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
            SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (
                SELECT c, list(f ORDER BY i) AS v FROM (
                    SELECT c, i, CAST((s - ((s % t) + t) % t) // t AS BIGINT) AS f FROM (
                        SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS t
                        FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c) m ON m.c = o.c)"""
            )
    return f"""
        WITH {", ".join(steps)}
        SELECT a.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} z ON z.c = a.c"""


TERMS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op12_lexical_search": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS t FROM documents),
        s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS held FROM d),
        m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(t) * docs) // held) AS m FROM d, s),
        i AS MATERIALIZED (SELECT q, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS q, item_id, {TERMS_SQL} AS t FROM benchmark)),
        f AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
        scored AS (
            SELECT i.q, any_value(i.item_id) AS item_id, m.r, any_value(m.doc_id) AS doc_id,
                   CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * m.m))) AS BIGINT) AS score
            FROM i JOIN f ON f.term = i.term JOIN w ON w.term = i.term JOIN m ON m.r = f.r GROUP BY i.q, m.r)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""",
    "op11_centroid_clustering": clustering_sql(),
    "op5_hamming_top_k": """
        WITH codes AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: (coalesce(x, 0) > 0)::INT) AS bits FROM embeddings WHERE embedding IS NOT NULL),
        pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
                   list_sum(list_transform(list_zip(q.bits, v.bits), lambda p: (p[1] <> p[2])::INT))::INT AS distance
            FROM codes q JOIN codes v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, neighbor_id, distance, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM pairs) WHERE rank <= 10""",
}
