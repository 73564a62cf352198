"""Upserts into a bucketed table against a dictionary."""

import random

import pytest

from opinara.operators import stored


def files(spark, path):
    return {f for f in spark.read.parquet(path).inputFiles()}


def test_upserts_write_what_changes(spark, tmp_path):
    rng, path, want = random.Random(4), str(tmp_path / "t"), {}
    schema = "a long, b string, v double, l array<string>, at long"
    key = lambda: (rng.choice([None, *range(40)]), rng.choice(["x", None]))
    seen = set()
    for batch in range(4):
        rows = [(*key(), rng.choice([None, rng.random()]), [str(i)] if i % 3 else None, i) for i in range(30 if batch else 200)]
        before = files(spark, path) if batch else set()
        touched = stored.upsert_into(path, spark.createDataFrame(rows, schema).repartition(3), ["a", "b"], "at", 16)
        for a, b, v, l, _ in rows:
            want[a, b] = (v, l)
        assert {(r["a"], r["b"]): (r["v"], r["l"]) for r in stored.read(spark, path, 16).collect()} == want
        left = {f for f in before if f in files(spark, path)}
        assert {f.split("bucket=")[1].split("/")[0] for f in before - left} == {str(t) for t in touched} & {f.split("bucket=")[1].split("/")[0] for f in before}
        now = files(spark, path)
        assert stored.upsert_into(path, spark.createDataFrame(rows, schema), ["a", "b"], "at", 16) == [] and files(spark, path) == now
        seen |= set(touched)
    assert len(seen) > 8 and stored.upsert_into(path, spark.createDataFrame([], schema), ["a", "b"], "at", 16) == []
    with pytest.raises(ValueError, match="buckets"):
        stored.upsert_into(path, spark.createDataFrame([], schema), ["a", "b"], "at", 8)
