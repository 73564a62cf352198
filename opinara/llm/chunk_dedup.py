"""Exact deduplication by content-defined chunk recipes.

A text, without the characters of ``[\\x20\\x09-\\x0D]``, is cut where a hash of its last 16 bytes says so. Each chunk gets
an identifier, which is verified by comparing the bytes of all chunks that share it; a document is then the ordered list
of its chunks' identifiers, and only those lists are shuffled and compared. A chunk's bytes move once per task that met it.

Defined results: null text counts as empty; all empty texts are equal. doc_id may be null (last in ties). Repeated rows are
copies, of which one stays. An empty table gives an empty table. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.llm.common import durable, even_join, same_rows, slices, whole_row

SPACE = b" \t\n\x0b\x0c\r"
WINDOW = 16
MEAN_BITS = 11  # a chunk has about 2 KiB
MAX_CHUNK = 1 << 16
ID_BYTES = 16
NO_ID = -(1 << 63)  # stands for a null doc_id in joins

RECIPES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("recipe", T.BinaryType()),
    ]
)
CHUNKS = T.StructType([T.StructField("chunk_id", T.BinaryType()), T.StructField("bytes", T.BinaryType())])

_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: bytes) -> np.ndarray:
    """Ends of chunks inside data, by content alone: after a byte whose window hashes to zero in the top bits."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunks_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each text, of MAX_CHUNK bytes at most. The first has WINDOW bytes at least; later cuts may lie closer."""
    cuts, at = cut_points(b"".join(texts)) if texts else [], 0
    for text in texts:
        inner = cuts[np.searchsorted(cuts, at + WINDOW) : np.searchsorted(cuts, at + len(text))] - at
        bounds = [0, *inner.tolist(), len(text)]
        yield [text[i : min(i + MAX_CHUNK, b)] for a, b in zip(bounds, bounds[1:]) for i in range(a, b, MAX_CHUNK)]
        at += len(text)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        for part in slices(batch, 1):
            yield part.column(0).to_pylist(), [raw or b"" for raw in part.column(1).cast(pa.binary()).to_pylist()]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, raws in _slices(batches):
        texts = [raw.translate(None, SPACE) for raw in raws]
        yield pa.record_batch(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(raw.decode("utf-8", "replace")) for raw in raws], pa.int64()),
                pa.array([hashlib.sha256(text).hexdigest() for text in texts], pa.string()),
                pa.array([b"".join(map(xxhash.xxh3_128_digest, parts)) for parts in chunks_of(texts)], pa.binary()),
            ],
            names=RECIPES.names,
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, raws in _slices(batches):
        found = {(xxhash.xxh3_128_digest(c), c) for parts in chunks_of([raw.translate(None, SPACE) for raw in raws]) for c in parts}
        yield pa.record_batch([pa.array([k for k, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())], names=CHUNKS.names)


def chunk_store(docs: DataFrame) -> DataFrame:
    """Every distinct chunk once: (chunk_id, bytes). An identifier with two rows isn't verified."""
    return docs.select("doc_id", "text").mapInArrow(_chunks, CHUNKS).distinct()


def recipes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, text_sha256, recipe), recipe being the chunks' identifiers in order."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_recipes, RECIPES)
    return durable(found.withColumn("row", F.monotonically_increasing_id()), "recipes")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text, ...)."""
    found = recipes(docs)
    doubtful = chunk_store(docs).groupBy("chunk_id").count().where("count > 1").select("chunk_id")
    doubtful = durable(doubtful, "doubtful")
    if doubtful.isEmpty():
        found = found.withColumn("more", F.lit(""))
    else:  # documents with a chunk whose identifier stands for other bytes too are told apart by their whole digest
        places = F.sequence(F.lit(0), F.floor(F.length("recipe") / ID_BYTES).cast("int") - 1)
        parts = found.where(F.length("recipe") > 0).select("row", F.explode(F.transform(places, lambda i: F.substring("recipe", i * ID_BYTES + 1, F.lit(ID_BYTES)))).alias("chunk_id"))
        hit = parts.join(doubtful, "chunk_id", "left_semi").select("row").distinct()
        found = found.join(hit.withColumn("hit", F.lit(True)), "row", "left").withColumn("more", F.when(F.col("hit"), F.col("text_sha256")).otherwise("")).drop("hit")
    groups = found.groupBy("recipe", "more").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"),
    )
    many = groups.where("group_size > 1").select("recipe", "more", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    all_rows = even_join(found, many, ["recipe", "more"], "left")
    alone = F.col("group_size").isNull()
    return all_rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: the longest, of the first doc_id; among rows that are
    equal in both, that of the smallest hash. Decisions are by text, length and doc_id, so that no other text of a doc_id
    goes with a copy. Whole rows move once; what a task has several of is thinned before."""
    verdicts = exact_dedup(docs).where("kept").select(F.col("text_sha256").alias("bare"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    text = F.coalesce("text", F.lit(""))
    bare = F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", ""), 256)
    keyed = docs.select(bare.alias("bare"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.length(text).alias("n"), same_rows(docs).alias("h"), whole_row(docs).alias("row"))
    nth = F.row_number().over(Window.partitionBy("bare", "id").orderBy(F.desc("n"), "h"))
    first = keyed.withColumn("nth", nth).where("nth = 1")
    return first.join(verdicts, ["bare", "id"], "left_semi").select("row.*")
