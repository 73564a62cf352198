"""What the operators of this subpackage share: reading, durable tables, joins that tolerate hot keys, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.storage import discard, durable, settle, shared_dir

__all__ = ["SLICE_BYTES", "components", "discard", "durable", "even_join", "marked", "settle", "same_rows", "shared_dir", "slices", "table", "whole_row"]

#: Bytes of text that a Python step works on at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in parts whose texts in column have about SLICE_BYTES together; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // SLICE_BYTES
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(bounds, bounds[1:]))
    pa.default_memory_pool().release_unused()  # workers live on: what a batch has taken goes back with it


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one, so that no name of theirs can clash with a name inside an operator."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def same_rows(docs: DataFrame) -> Column:
    """A hash of a row's columns, but for those of kinds that have none, to choose among rows that are otherwise equal."""
    plain = [f.name for f in docs.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(*(F.col(f"`{c}`") for c in plain)) if plain else F.lit(0)


BITMAP_BITS = 1 << 22
_PER_MAP = 1 << 15  # what one row of bitmap_construct_agg holds


def marked(df: DataFrame, value: Column, wanted: DataFrame) -> DataFrame:
    """The rows of df whose value may be in wanted's only column: all that are, and others by chance. A bitmap of fixed size
    (BITMAP_BITS / 8 bytes, broadcast) tells, so that a join with wanted moves few rows where wanted is small."""
    place = lambda v: F.pmod(F.xxhash64(v), F.lit(BITMAP_BITS))
    places = wanted.select(place(F.col(wanted.columns[0])).alias("at"))
    maps = places.groupBy(F.floor(F.col("at") / _PER_MAP).alias("_part")).agg(F.bitmap_construct_agg(F.col("at") % _PER_MAP).alias("_bits"))
    placed = df.withColumn("_at", place(value)).withColumn("_part", F.floor(F.col("_at") / _PER_MAP))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_at % {_PER_MAP} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) > 0
    return placed.join(F.broadcast(maps), "_part").where(hit).drop("_part", "_at", "_bits")


def even_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join for a left side with hot keys and a right side that was aggregated by the same keys.

    The hash that joins as well keeps the planner from reusing the aggregate's partitioning: both sides get an
    exchange of their own, so that adaptive execution can split the left side's oversized partitions.
    """
    mark = "_even_" + uuid.uuid4().hex[:8]
    salt = F.xxhash64(*keys, F.lit(7))
    return left.withColumn(mark, salt).join(right.withColumn(mark, salt), [*keys, mark], how).drop(mark)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (a, b) of any orderable type, any direction, repeats and loops allowed. Returns (node, root): for every
    node with a link to another one, the smallest node it reaches. A round shuffles the edges twice; nothing is collected.
    Each of a round's two steps is a plan and a table of its own, and so is the result: the driver holds small plans alone.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = durable(edges, name), None
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state[0] == 0 or state == before:
            found = durable(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct(), name)
            discard(edges)
            return found
        before = state
        both = edges.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = durable(even_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = even_join(large, least, ["a"])
        edges = durable(small.select(F.inline(F.array(pair("b", "m"), pair("a", "m")))).where("a <> b").distinct(), name)
        discard(large)
        settle(edges.sparkSession)
