"""Small documents for the tests."""

import pyarrow.parquet as pq


def documents(n):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).slice(0, n).to_pylist()
    rows = [(r["doc_id"], r["text"][:3000]) for r in rows]
    return rows + [(10_000 + i, t) for i, t in rows[: max(0, n - len(rows))]]


def odd_documents():
    return [(None, "no id"), (800_001, None), (800_002, ""), (800_003, " \n\t "), (800_004, "x"), (800_005, "é" * 50_000), (800_006, "word " * 20_000), (800_004, "x")]
