"""Exact top-k by pivots: the same rows as scoring all pairs, from far fewer pairs where vectors cluster."""
import numpy as np
import pytest

from tally.operators import pivots, retrieval

DOC = "doc_id long, embedding array<double>"
QUERY = "query_id long, query_embedding array<double>"


def model(docs, queries, k):
    out = []
    for q, x in queries:
        if x is None or len(x) != 6 or not any(x):
            continue
        near = []
        for i, y in docs:
            if y is None or len(y) != 6 or not any(y):
                continue
            dot, a, b = 0.0, 0.0, 0.0
            for u, v in zip(y, x, strict=True):
                dot, a, b = dot + u * v, a + u * u, b + v * v
            near.append((round(1 - dot / (a ** 0.5 * b ** 0.5), 9), i))
        out += [(q, i, rank) for rank, (_, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "k"), [("clustered", 4), ("scattered", 3), ("copies", 7), ("few", 5)])
def test_pivots_equal_all_pairs(spark, monkeypatch, kind, k):
    monkeypatch.setattr(pivots, "ROWS", 50)  # rings are dealt to several parts
    r = np.random.default_rng(k)
    n = 3 if kind == "few" else 900
    x = r.normal(size=(n, 6))
    if kind == "clustered":
        x = r.normal(size=(40, 6))[r.integers(0, 40, n)] + 0.01 * x
    if kind == "copies":
        x[::2] = x[0]
    docs = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 6), (9003, [1.0]), (9004, (2 * x[0]).tolist())]
    queries = [(i, (3 * x[i * 7 % n] + 0.001).tolist()) for i in range(12)] + [(50, None), (51, [0.0] * 6), (52, [1.0, 2.0]), (53, (-x[0]).tolist())]
    d, q = spark.createDataFrame(docs, DOC), spark.createDataFrame(queries, QUERY)
    got = retrieval.cosine_topk(d, q, k, 6)
    assert sorted((t.query_id, t.doc_id, t.rank) for t in got.collect()) == model(docs, queries, k)
    if kind == "clustered":
        assert retrieval._scored(d, q, k, 6).count() < 0.25 * n * 13


def test_no_documents_or_queries(spark):
    none, q = spark.createDataFrame([], DOC), spark.createDataFrame([(1, [1.0] * 6)], QUERY)
    assert retrieval.cosine_topk(none, q, 3, 6).count() == 0
    one = spark.createDataFrame([(5, [1.0] * 6)], DOC)
    assert retrieval.cosine_topk(one, spark.createDataFrame([], QUERY), 3, 6).count() == 0
    assert [t.doc_id for t in retrieval.cosine_topk(one, q, 3, 6).collect()] == [5]
