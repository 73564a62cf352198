"""The nearest of each against all pairs."""

import numpy as np

from opinara.plans import search


def plain(queries, chunks, k):
    norm = lambda v: float(np.sqrt((np.array(v, float) ** 2).sum()))
    good = lambda v: v is not None and None not in v and np.isfinite(v).all() and norm(v) > 0
    out = []
    for i, q in queries:
        near = [(-float((np.array(q) * np.array(c)).sum()) / (norm(q) * norm(c)), j) for j, c in chunks if good(q) and good(c) and len(c) == len(q)]
        out += [(i, j, place) for place, (_, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def test_the_nearest_of_each_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    grid = lambda n, width: [(rng.integers(-2, 3, width) / 4).tolist() for _ in range(n)]  # many equal ones and equal scores
    odd = [None, [], [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0], [1e-3, 0.0], [1.0, 2.0]]
    queries, chunks = list(enumerate(grid(60, 4) + odd)), list(enumerate(grid(150, 4) + odd + grid(20, 2)))
    schema = "{} long, embedding array<double>"
    a, b = spark.createDataFrame(queries, schema.format("query_id")), spark.createDataFrame(chunks, schema.format("chunk_id"))
    for k, block in ((1, 16), (7, 16), (7, 1000), (400, 50)):
        found = search.nearest_of_each(a, b, k, block=block)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["query_id"], r["chunk_id"], r["place"]) for r in found.collect()) == plain(queries, chunks, k)
    turned = search.nearest_of_each(b.toDF("query_id", "embedding"), a.toDF("chunk_id", "embedding"), 3, block=16)  # more blocks of queries than of chunks
    assert sorted((r["query_id"], r["chunk_id"], r["place"]) for r in turned.collect()) == plain(chunks, queries, 3)
    assert search.nearest_of_each(a.limit(0), b, 3).count() == 0


def test_blocks_do_not_grow_in_number_with_the_rows(spark, monkeypatch):
    """What moves is each row as often as the other side has blocks."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    assert search._blocks(df, "query_id", "q", 1)[1] == 16 and search._blocks(df, "query_id", "q", 150)[1] == 2
    monkeypatch.setattr(search, "HELD", 40, raising=False)
    monkeypatch.setattr(search, "TILE", 20, raising=False)
    assert 16 < search._blocks(df, "query_id", "q", 1)[1] <= 20
    found = search.nearest_of_each(df, df.withColumnRenamed("query_id", "chunk_id"), 3, block=50)
    assert sorted((r["query_id"], r["chunk_id"], r["place"]) for r in found.collect()) == plain(rows, rows, 3)
