"""Upserts into a stored table, of which only the buckets are written that change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.storage import discard, durable, exists

BUCKETS = 256


def _last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last; a task keeps one row of each key before any row moves."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def read(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    return spark.read.parquet(f"{path}/of={buckets}").drop("bucket")


def upsert_into(path: str, new: DataFrame, keys: list[str], position: str, buckets: int = BUCKETS, bucket: Column | None = None) -> list[int]:
    """Puts the rows of new into the table at path, by keys (nulls are equal), of new rows with equal keys the last by position, and
    returns the numbers of the buckets that were written.

    The table is made of folders by bucket, a hash of the keys (or of bucket, from 0 to buckets - 1, the same in each call). Only
    those that get a row which they don't have yet are read and written again, each replaced as a whole when all its rows are
    there; a batch that is repeated writes nothing. Other columns must be the table's. One writer at a time.
    """
    spark, root = new.sparkSession, f"{path}/of={buckets}"
    if exists(spark, path) and not exists(spark, root):
        raise ValueError(f"{path} doesn't have {buckets} buckets")
    number = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if bucket is None else bucket
    columns = [c for c in new.columns if c != position]
    rows = durable(_last(new, keys, position).select(*columns).withColumn("bucket", number.cast("int")), "upserts")
    if not exists(spark, root):
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most buckets
        rows.repartition("bucket").write.partitionBy("bucket").parquet(root)
        discard(rows)
        return sorted(touched)
    stored = spark.read.parquet(root).select(*columns, "bucket")
    had = stored.join(F.broadcast(rows.select("bucket").distinct()), "bucket", "left_semi")  # buckets rows at most: others aren't read
    equal = lambda names: reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names))
    fresh = rows.alias("n").join(had.alias("o"), equal([*keys, "bucket"]) & equal([c for c in columns if c not in keys]), "left_anti")
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most buckets
    if touched:
        both = stored.where(F.col("bucket").isin(touched)).withColumn("_new", F.lit(0)).union(rows.where(F.col("bucket").isin(touched)).withColumn("_new", F.lit(1)))
        merged = durable(_last(both, [*keys, "bucket"], "_new").select(*columns, "bucket"), "merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)
        discard(merged)
    discard(rows)
    return touched
