"""Short codes of vectors: each part of a vector becomes the number of its nearest codebook entry, found by VA-file filtering."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import durable, even_join

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
CELLS = 4  # to which the coordinates of entries are quantised: two bits each
_LIMB = 32  # bits of a piece of a sum
_MOST = 2**63 - 1
_BLOCK = 1 << 21  # numbers that one step of the distances works on


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, embedding) of the vectors without nulls, NaN and infinities, and of the dimension that the one with the
    smallest vec_id has."""
    good = vectors.select("vec_id", "label", "embedding").where(_finite(F.col("embedding")))
    first = good.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    width = first[0] if first else 0
    return good.where(F.size("embedding") == width), width


def integers(values: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Rows of finite numbers as floor(SCALE * x), in the shape (rows, parts, numbers of a part); a length that parts don't divide
    is filled up with zeros. float64 where all distances are exact in it, else Python's integers."""
    rows, width = values.shape
    part = max(1, -(-width // parts))
    scaled = np.zeros((rows, parts * part), np.float64)
    scaled[:, :width] = np.floor(np.minimum(np.maximum(values.astype(np.float64), -1e300), 1e300) * SCALE)
    if not _exact(scaled, part):
        whole = np.zeros((rows, parts * part), object)
        whole[:, :width] = [[math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE for x in row] for row in values.tolist()]
        scaled = whole
    return scaled.reshape(rows, parts, part)


def _exact(values: np.ndarray, part: int) -> bool:
    return values.size == 0 or bool(np.abs(values).max() < math.sqrt(2**53 / part) / 2)


class Codebooks:
    """entries[part][entry] is a list of integers. Coordinates are kept as cells: per part and position, the entries' order is cut
    into CELLS cells, each with its smallest and its greatest value."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        exact = np.array(entries, object)
        self.values = exact.astype(np.float64) if exact.size and _exact(exact, exact.shape[2]) else exact
        parts, count, width = self.values.shape
        rank = np.argsort(np.argsort(self.values, axis=1, kind="stable"), axis=1)
        cell = rank * CELLS // count
        self.low, self.high = (np.zeros((parts, width, CELLS), self.values.dtype) for _ in range(2))
        self.place = np.zeros((parts, width, CELLS, count), self.values.dtype)
        for p, w, c in np.ndindex(parts, width, CELLS):
            inside = self.values[p, cell[p, :, w] == c, w]
            if len(inside):
                self.low[p, w, c], self.high[p, w, c] = min(inside), max(inside)
        p, e, w = np.indices(cell.shape)
        self.place[p, w, cell, e] = 1

    def nearest(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry and its squared distance, for each row and part. The square of what parts a row's coordinate from a cell,
        at least and at most, is looked up in a table of the row; sums of them bound the distances to all entries. Distances
        are calculated where the lower bound doesn't exceed the least upper one."""
        if block.dtype != self.values.dtype or not _exact(block, block.shape[2]):
            whole = np.vectorize(int, otypes=[object])
            block, values = (whole(a) if a.size else a.astype(object) for a in (block, self.values))
            low, high, place = (whole(a) for a in (self.low, self.high, self.place))
        else:
            values, low, high, place = self.values, self.low, self.high, self.place
        (parts, count, width), rows = values.shape, len(block)
        best, error = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), block.dtype)
        for p in range(parts):
            row = block[:, p, :, None]
            under, over = low[p] - row, row - high[p]
            least, most = np.maximum(np.maximum(under, over), 0), np.maximum(row - low[p], high[p] - row)
            lookup = place[p].reshape(width * CELLS, count)
            lower, upper = ((t * t).reshape(rows, width * CELLS) @ lookup for t in (least, most))
            r, e = np.nonzero((lower <= upper.min(axis=1)[:, None]).astype(bool))
            gap = block[r, p] - values[p, e]
            distance = np.full((rows, count), 2**2200 if block.dtype == object else np.inf, block.dtype)
            distance[r, e] = (gap * gap).sum(axis=1)
            best[:, p] = np.argmin(distance, axis=1)
            error[:, p] = distance[np.arange(rows), best[:, p]]
        return best, error

    def digest(self) -> str:
        """SHA-256 of all numbers by part, entry and position."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def _blocks(batch: pa.RecordBatch, column: int, width: int, parts: int) -> Iterator[tuple[int, int, np.ndarray]]:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    step = max(1, _BLOCK // (max(width, parts) * CELLS))
    for a in range(0, batch.num_rows, step):
        yield a, min(a + step, batch.num_rows), integers(values[a : a + step], parts)


def _sums(kept: DataFrame, width: int, books: Codebooks) -> DataFrame:
    """For each part and entry, the number of parts assigned to it (at = -1) and their sums by position, in pieces of 32 bits, so
    that sums of any size are exact: (part, entry, at, piece, total)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = books.values.shape
        total, count = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for batch in batches:
            for _, _, block in _blocks(batch, 0, width, shape[0]):
                best, _ = books.nearest(block)
                for p in range(shape[0]):
                    count[p] += np.bincount(best[:, p], minlength=shape[1])
                    for e in np.unique(best[:, p]).tolist():
                        total[p, e] += np.array([int(x) for x in block[best[:, p] == e, p].sum(axis=0)], object)
        rows = [(p, e, -1, 0, int(n)) for (p, e), n in np.ndenumerate(count) if n]
        for (p, e, w), value in np.ndenumerate(total):
            piece = 0
            while not -(2**31) <= value < 2**31:
                rows.append((p, e, w, piece, value & (2**_LIMB - 1)))
                value, piece = value >> _LIMB, piece + 1
            rows.append((p, e, w, piece, value))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int32()] * 4, pa.int64()))], names=["part", "entry", "at", "piece", "total"])

    partial = kept.select("embedding").mapInArrow(task, "part int, entry int, at int, piece int, total long")
    return partial.groupBy("part", "entry", "at", "piece").agg(F.sum("total").alias("total"))


def fit(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of usable() vectors, from all of them: the first ones by vec_id, then rounds of assigning every part to its nearest
    entry and moving the entry to the floor of the mean. None without vectors. The driver sees entries * parts sums a round."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    if not first:
        return None
    start = integers(np.array([r.embedding for r in first], np.float64).reshape(len(first), width), parts)
    books = Codebooks([[[int(x) for x in row] for row in start[:, p]] for p in range(parts)])
    for _ in range(rounds):
        sums: dict[tuple[int, int, int], int] = {}
        for r in _sums(kept, width, books).collect():
            key = (r.part, r.entry, r.at)
            sums[key] = sums.get(key, 0) + (r.total << _LIMB * r.piece)
        moved = [
            [[sums[p, e, w] // sums[p, e, -1] for w in range(len(entry))] if (p, e, -1) in sums else entry for e, entry in enumerate(part)]
            for p, part in enumerate(books.entries)
        ]
        if moved == books.entries:  # nothing moves any more
            break
        books = Codebooks(moved)
    return books


def encode(kept: DataFrame, width: int, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hexadecimal digits for each part, and the squared distances' sum, at most 2^63 - 1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, _, block in _blocks(batch, 2, width, books.values.shape[0]):
                best, error = books.nearest(block)
                codes += [row.tobytes().hex() for row in best.astype(np.uint8)]
                errors += [min(int(sum(map(int, row))), _MOST) for row in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("vec_id", "label", "embedding").mapInArrow(task, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """codes (a column code) with the vectors that they stand for, as column decoded."""
    entries = F.from_json(F.lit(str([[[x / SCALE for x in e] for e in part] for part in books.entries])), "array<array<array<double>>>")
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("decoded", F.slice(F.concat(*(entries[p][at(p)] for p in range(len(books.entries)))), 1, width))


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each usable vector.

    vectors: vec_id, embedding (array of float or double), label; further columns are left aside. Rows whose vector is null or has
    null, NaN or infinite numbers are left out, and so are those whose length isn't that of the smallest vec_id's vector: no codebook
    fits them. Repeated rows count each; rows of one vec_id come in order of their vectors, a null vec_id last; fewer than 16 vectors
    make a codebook of as many entries; an empty table gives no rows. Numbers of any size are reckoned exactly; errors end at
    2^63 - 1, sums of them too. label_error adds up the errors of rows with the same label, null being one.
    """
    kept, width = usable(vectors)
    books = fit(kept, width)
    if books is None:
        return encode(kept, width, Codebooks([[[0]]])).select("vec_id", "code", "error", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = durable(encode(kept, width, books), "codes").withColumns({"none": F.col("label").isNull(), "same": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    keys = ["none", "same"]
    return even_join(coded, coded.groupBy(*keys).agg(total.alias("label_error")), keys).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )
