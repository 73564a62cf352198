"""Running sums in two levels, and what is built on them."""

import random

from pyspark.sql import functions as F

from opinara.operators import entities as E
from opinara.operators import metrics as M
from opinara.operators import prefix


def test_sums_and_lasts_of_earlier_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i // 7, i, rng.randint(-5, 5), rng.choice([None, "x", "y"])) for i in range(120)]
    df = spark.createDataFrame(rows, "w string, block long, at long, n int, s string").repartition(5)
    found = {r["at"]: (r["sum"], r["last"]) for r in prefix.before(df, ["w"], "block", ["at"], {"sum": F.col("n")}, {"last": F.col("s")}).collect()}
    for w, _, at, _, _ in rows:
        before = [r for r in rows if r[0] == w and r[2] < at]
        assert found[at] == (sum(r[3] for r in before), next((r[4] for r in reversed(before) if r[4]), None))


def test_ranks_of_a_hot_entity_with_values_of_all_kinds(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 10 else rng.choice(["b", "c", None]), None if i % 50 == 3 else rng.random() * 10, i % 3 == 0) for i in range(4000)] + [("none", None, False), ("one", 5.0, True)]
    df = spark.createDataFrame(rows, "entity_id string, rating double, answered boolean").repartition(4)
    found = {r["entity_id"]: tuple(r)[1:] for r in M.rank_metrics(df, ["entity_id"]).collect()}
    for e in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == e]
        ratings = sorted(r[1] for r in own if r[1] is not None)
        low = sum(r[1] is not None and r[1] < 7 and not r[2] for r in own)
        at = (ratings[len(ratings) // 2], ratings[max(0, int(len(ratings) * 0.1) - 1)]) if ratings else (None, None)
        assert found[e] == (len(own), low, *at)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # ranges this small would be put together
    try:
        ranges = prefix.in_ranges(df, ["entity_id"], ["rating"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in ranges.groupBy("entity_id", "block").count().collect()]
    assert max(sizes) < len(rows) / 2  # of 4 ranges, though one entity has nine tenths


def test_a_sample_moves_no_more_than_n_rows_of_a_task(spark):
    df = spark.range(1000).selectExpr("concat('hot', id % 1) AS entity_id", "id AS pos", "'abc' AS text")
    sample = E.sample_within(df, ["entity_id"], "text", 20, 9)
    assert "WindowGroupLimit" in sample._jdf.queryExecution().optimizedPlan().toString() and [r["pos"] for r in sample.orderBy("pos").collect()] == list(range(6))
