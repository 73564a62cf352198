"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are dealt by hash into shards of about SHARD pieces, which are packed apart from each other; a shard's last bins are
all that splitting costs. In a shard, pieces go by falling length to the open bin they leave least room in. If none takes
a piece, a bin opens at the permitted size of least cost for each token that it can still expect. This is done once for
all sizes together and once for the sizes up to each one; the cheapest outcome stays, after every bin has been downsized to
the smallest permitted size that holds its contents.

A document's length is its tokens under a byte-level vocabulary (tokens: rank file and pattern), counted by the tiktoken
library, and one separator; a length of the caller's own may be given instead, or an estimate of a token for every four UTF-8
bytes is taken. With carry_text each row has the text of its piece, so that the rows of a bin are its whole content.

Defined results: null text counts as empty and takes one token. A document longer than the largest size is cut into pieces of
that size and a rest; where a cut would split a character, the piece ends before it. Repeated rows are packed each for
itself, dealt out by their place in the table, not by what they hold; ties go by doc_id (null first) and piece. An empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.bpe import ranks
from opinara.llm.common import durable, slices

SIZES = (512, 1024, 2048, 4096, 8192)
SHARD = 8192
SHARD_BYTES = 8 << 20  # of text that a shard carries
PACKED = "doc_id long, piece int, start long, length int, bin_id long, capacity int, bin_offset int, bin_fill int"


def cost(size: int) -> float:
    """Of one sequence: its tokens, their attention, and a step of its own."""
    return size * (1 + size / 65536) + 64


def best_fit(lengths: list[int], sizes: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """The bin of each length, given in falling order, and the size at which each bin opened."""
    left, opened, where = sum(lengths), [], []
    room: list[int] = []  # of open bins, each value once, rising
    bins: dict[int, list[int]] = {}
    for length in lengths:
        at = bisect_left(room, length)
        if at < len(room):
            space = room[at]
            chosen = bins[space].pop()
            if not bins[space]:
                del bins[space], room[at]
        else:
            space = min((s for s in sizes if s >= length), key=lambda s: (cost(s) / min(s, left), s))
            chosen = len(opened)
            opened.append(space)
        where.append(chosen)
        left -= length
        if rest := space - length:
            if rest not in bins:
                bins[rest] = []
                insort(room, rest)
            bins[rest].append(chosen)
    return where, opened


def pack(lengths: list[int], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in falling order: bins, and each bin's fill and downsized capacity, at the least total cost found."""
    best, permitted = None, np.array(sizes)
    for usable in dict.fromkeys([sizes, *(tuple(s for s in sizes if s <= top) for top in sizes if top >= lengths[0])]):
        where = np.array(best_fit(lengths, usable)[0])
        fill = np.bincount(where, lengths).astype(int)
        capacity = permitted[np.searchsorted(permitted, fill)]
        total = sum(cost(int(s)) * n for s, n in zip(*np.unique(capacity, return_counts=True)))
        if best is None or total < best[0]:
            best = total, where, fill, capacity
    return best[1:]


def _pack_shard(key: tuple, rows: pd.DataFrame, sizes: tuple[int, ...], columns: list[str]) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "uid"], ascending=[False, True, True, True], na_position="first", ignore_index=True)
    where, fill, capacity = pack(rows["length"].tolist(), sizes)
    rows["bin_id"] = (int(key[0]) << 32) + where
    rows["bin_offset"] = rows.groupby("bin_id")["length"].cumsum() - rows["length"]
    rows["capacity"], rows["bin_fill"] = capacity[where], fill[where]
    return rows[columns]


def token_length(text: Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long") + 1


def cuts(tokens: list[bytes], top: int) -> list[int]:
    """Where a document of tokens and a separator is cut into pieces of top tokens at most, in tokens; never within a character."""
    ends = [top]
    while ends[-1] <= len(tokens):
        at = ends[-1]
        while at < len(tokens) and tokens[at][0] & 0xC0 == 0x80:  # the next token begins amid a character
            at -= 1
        ends[-1:] = [at, at + top]
    return [0, *ends[:-1], len(tokens) + 1]


def _measure(batches: Iterator[pa.RecordBatch], rank: dict[bytes, int], pattern: str, top: int, carry_text: bool) -> Iterator[pa.RecordBatch]:
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rank, special_tokens={})
    for batch in batches:
        for part in slices(batch, 1):
            doc_ids, pieces, starts, lengths, texts = [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = own.encode_ordinary(text or "")
                if len(ids) < top:
                    bounds, said = [0, len(ids) + 1], [text or ""]
                else:
                    tokens = own.decode_tokens_bytes(ids)
                    bounds = cuts(tokens, top)
                    said = [b"".join(tokens[a:b]).decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])] if carry_text else []
                n = len(bounds) - 1
                doc_ids += [doc_id] * n
                pieces += range(n)
                starts += bounds[:-1]
                lengths += [b - a for a, b in zip(bounds, bounds[1:])]
                texts += said if carry_text else []
            columns = [pa.array(doc_ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32())]
            yield pa.record_batch(columns + [pa.array(texts, pa.string())] * carry_text, names=["doc_id", "piece", "start", "length", "text"][: 4 + carry_text])


def pieces_of(docs: DataFrame, top: int, tokens: tuple[str, str] | None, length: Column | None, carry_text: bool) -> DataFrame:
    """(doc_id, piece, start, length, text if carry_text): what is to be packed."""
    if tokens is not None:
        if top < 8:
            raise ValueError("the largest size must hold a character of four bytes")
        measure = partial(_measure, rank=ranks(tokens[0]), pattern=tokens[1], top=top, carry_text=carry_text)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, piece int, start long, length int" + ", text string" * carry_text)
    if carry_text:
        raise ValueError("texts are cut by tokens: carry_text needs tokens")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (token_length(F.col("text")) if length is None else length).alias("n"))
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)).cast("int")))
    start = F.col("piece").cast("long") * top
    return sized.select("doc_id", "n", cut.alias("piece")).select("doc_id", "piece", start.alias("start"), F.least(F.lit(top), F.col("n") - start).cast("int").alias("length"))


def best_fit_packing(docs: DataFrame, sizes: tuple[int, ...] = SIZES, tokens: tuple[str, str] | None = None, length: Column | None = None, carry_text: bool = False) -> DataFrame:
    """A row for every piece of every document: its place in the document and in its bin, the bin's capacity and fill, and
    the piece's text if carry_text."""
    sizes = tuple(sorted(set(sizes)))
    pieces = pieces_of(docs, sizes[-1], tokens, length, carry_text)
    pieces = durable(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    size = F.sum(F.octet_length("text")) if carry_text else F.lit(0)
    stats = pieces.agg(F.count("*").alias("n"), size.alias("bytes")).first()
    shards = max(1, -(-stats["n"] // SHARD), -(-(stats["bytes"] or 0) // SHARD_BYTES))
    schema = PACKED + ", text string" * carry_text
    columns = [c.split()[0] for c in schema.split(", ")]

    def pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(key, rows, sizes, columns)

    return pieces.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(pack_shard, schema)
