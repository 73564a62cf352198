"""Hybrid retrieval: vector and keyword candidates, one row of each, reranked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.functions import vectors as V


def vector_candidates(chunks: DataFrame, query: list[float], k: int, id_: str = "chunk_id") -> DataFrame:
    """The k nearest by cosine, null embeddings last, with vector_rank from 0."""
    near = chunks.withColumn("distance", 1 - V.raw_cosine(F.col("embedding"), V.literal(query)))
    order = [F.col("distance").asc_nulls_last(), F.col(id_)]
    top = near.orderBy(*order).limit(k)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy(*order)) - 1)  # of k rows


SIDE = 16  # blocks of a side, as long as a block has no more than HELD numbers
HELD = 1 << 22
TILE = 1 << 22  # products at once


def _blocks(rows: DataFrame, id_: str, as_: str, block: int) -> tuple[DataFrame, int]:
    """(width, number, ids, vectors): usable vectors of one width in blocks; how many there are, in rows of block each, but SIDE at
    most, so that what moves grows with the rows alone; more only where a block would else have over HELD numbers."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("embedding").isNotNull() & usable & F.exists("embedding", lambda x: x != 0)).select(F.col(id_).alias("id"), F.col("embedding").alias("v"))
    n, most = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    count = max(1, min(-(-n // block), max(SIDE, -(-n * most // HELD))))
    placed = rows.withColumns({"width": F.size("v"), "number": F.pmod(F.xxhash64("id", "v"), F.lit(count))})
    packed = placed.groupBy("width", "number").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows"))
    return packed.select("width", F.col("number").alias(f"{as_}_number"), F.col("rows.id").alias(f"{as_}_ids"), F.flatten("rows.v").alias(f"{as_}_vectors")), count


def nearest_of_each(queries: DataFrame, chunks: DataFrame, k: int, id_: str = "chunk_id", block: int = 4096) -> DataFrame:
    """For each query (query_id, embedding) the k chunks (id_, embedding) of the greatest cosine, of equals the smallest id first:
    (query_id, id_, score, place from 1). Exact, whatever the number of either.

    Both sides are packed in blocks; a block of queries meets a block of chunks as a product of two matrices, tile by tile, of which
    each query's k best stay, and only these are merged. Vectors without a direction (null, empty, zeros, not finite) are nobody's
    neighbours, nor are those of other widths. A score doesn't depend on the block that it is found in.
    """
    (one, n), (other, m) = _blocks(queries, "query_id", "q", block), _blocks(chunks, id_, "c", block)
    each = lambda rows, name, count: rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    met = each(one, "c_number", m).join(each(other, "q_number", n), ["width", "q_number", "c_number"])  # each pair of blocks is a key of its own
    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)[id_]

    def best(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows of q in order: rows of c, the best first, and their scores."""
        norms = [np.sqrt((x * x).sum(axis=1)) for x in (q, c)]
        q_unit, c_unit = q / norms[0][:, None], c / norms[1][:, None]
        rows, columns, score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(q), -np.inf)
        step = max(1, TILE // len(q))
        for at in range(0, len(c), step):
            near = q_unit @ c_unit[at : at + step].T
            if at == 0 and near.shape[1] >= k:
                floor = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            r, s = np.nonzero(near >= floor[:, None] - 1e-9)  # products differ in their last digits by place
            parts = 1 + len(r) // 4096
            exact = [(q[i] * c[j + at]).sum(axis=1) / (norms[0][i] * norms[1][j + at]) for i, j in zip(np.array_split(r, parts), np.array_split(s, parts))]
            rows, columns, score = np.concatenate((rows, r)), np.concatenate((columns, s + at)), np.concatenate((score, *exact))
            order = np.lexsort((columns, -score, rows))
            rows, columns, score = rows[order], columns[order], score[order]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            nth = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
            floor[rows[nth == k - 1]] = score[nth == k - 1]
            rows, columns, score = rows[nth < k], columns[nth < k], score[nth < k]
        return rows, columns, score

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, found = [batch.column(j).slice(i, 1).flatten() for j in (0, 2)], [batch.column(j).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for j in (1, 3)]
                q, c = (v.reshape(len(n), -1) for v, n in zip(found, ids))
                for at in range(0, len(q), 1024):
                    rows, columns, score = best(q[at : at + 1024], c)
                    yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(rows + at)), ids[1].take(pa.array(columns)), pa.array(score)], names=["query_id", id_, "score"])

    found = met.select("q_ids", "q_vectors", "c_ids", "c_vectors").mapInArrow(task, f"query_id {kinds[0]}, `{id_}` {kinds[1]}, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_)
    return found.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)


def keyword_candidates(chunks: DataFrame, query: str, columns: list[str], k: int, id_: str = "chunk_id") -> DataFrame:
    """The first k by id with the query in a column, with keyword_rank from 0."""
    top = chunks.where(T.contains_any([F.col(c) for c in columns], query)).orderBy(id_).limit(k)
    return top.withColumn("keyword_rank", F.row_number().over(Window.orderBy(id_)) - 1)  # of k rows


def merged(vector: DataFrame, keyword: DataFrame, keys: list[str]) -> DataFrame:
    """Each candidate once, with the rank it has in either list; those of the vector list first (pos)."""
    ranks = [c for c in ("vector_rank", "keyword_rank")]
    both = vector.drop("distance").unionByName(keyword, allowMissingColumns=True)
    carried = [c for c in both.columns if c not in ranks and c not in keys]
    first = F.struct(F.col("vector_rank").isNull(), F.coalesce(*ranks))
    one = both.groupBy(*keys).agg(*(F.max(r).alias(r) for r in ranks), *(F.min_by(c, first).alias(c) for c in carried))
    return one.withColumn("pos", F.struct(F.col("vector_rank").isNull().alias("late"), F.coalesce(*ranks).alias("rank")))


def hybrid_search(chunks: DataFrame, query: str, vector: list[float] | None, k: int = 5, weights: tuple[float, float] = (0.65, 0.35), columns: tuple[str, ...] = ("body", "title", "tags")) -> DataFrame:
    """max(4k, 30) candidates of either kind, scored by cosine and word overlap; without a vector by words alone."""
    n = max(4 * k, 30)
    keyword = keyword_candidates(chunks, query, list(columns), n)
    one = merged(vector_candidates(chunks, vector, n), keyword, ["chunk_id"]) if vector else keyword.withColumn("pos", F.struct(F.lit(True).alias("late"), F.col("keyword_rank").alias("rank")))
    near = V.cosine(F.col("embedding"), V.literal(vector)) if vector else F.lit(0.0)
    words = T.lexical_overlap(F.lit(query), F.concat_ws(" ", "title", "body", "tags"))
    w, x = (weights[0] / sum(weights), weights[1] / sum(weights)) if vector else (0.0, 1.0)
    scored = one.withColumns({"vector_score": T.round_exact(near, 4), "keyword_score": T.round_exact(words, 4), "score": T.round_exact(w * near + x * words, 4)})
    return scored.orderBy(F.col("score").desc(), "pos", "chunk_id").limit(k)


def rank_bonus(rank: Column, missing: int) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.06 * F.coalesce(rank, F.lit(missing)))


def rerank(candidates: DataFrame, query: str, vector: list[float], k: int, candidate_k: int, weights: tuple[float, float, float, float] = (0.55, 0.30, 0.075, 0.075)) -> DataFrame:
    """Of candidates (embedding, body, vector_rank, keyword_rank, pos): the k best by cosine, overlap and both ranks."""
    parts = [V.cosine(F.col("embedding"), V.literal(vector)), T.lexical_overlap(F.lit(query), F.col("body")), rank_bonus(F.col("vector_rank"), candidate_k), rank_bonus(F.col("keyword_rank"), candidate_k)]
    total = sum(weights) or 1.0
    score = sum((w / total * p for w, p in zip(weights, parts)), F.lit(0.0))
    return candidates.withColumn("score", score).orderBy(F.col("score").desc(), "pos", "chunk_id").limit(k)


def answer_sources(chunks: DataFrame, query: str, vector: list[float], k: int, columns: tuple[str, ...] = ("product_name", "body", "summary", "tags")) -> DataFrame:
    """Citations of a retrieval answer: 3k candidates of either kind, one chunk a review, reranked, with rank from 1."""
    n = 3 * k
    one = merged(vector_candidates(chunks, vector, n), keyword_candidates(chunks, query, list(columns), n), ["review_id"])
    best = rerank(one, query, vector, k, n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "pos", "chunk_id")))  # of k rows


def evidence(vector: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """The vector list, then keyword rows it doesn't have, cut at k."""
    return merged(vector, keyword, ["chunk_id"]).orderBy("pos", "chunk_id").limit(k)
