"""SimHash near-duplicates by anchor points, alone (near_dedup) or as the first step before an exact similarity (similar_groups).

Fingerprints of 64 bits link at 3 or fewer differing bits, so that in one of their two halves at most 1 bit differs. For a
half, the anchors are the words of a covering code: the [31,26] Hamming code with one free bit, of covering radius 1. Each
fingerprint is at home at its nearest anchor and is replicated to every anchor within covering radius plus threshold, 2:
17 of 2**27. Any two that link meet at the home of either, where they are compared; each task returns a spanning forest
of its links instead of all pairs, and the links' components follow. An anchor of more than CROWD fingerprints is told by the
task that meets it; its fingerprints are first compared with their neighbours in order alone, and then only those of
different components with each other, in blocks dealt out over many tasks (across).

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other. Repeated
rows and copies share a fingerprint and are compared once. A null doc_id is only the smallest of its component if all are
null. An empty table gives an empty table. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import components, discard, durable, even_join, marked, same_rows, settle, slices, whole_row

SEED = 42
THRESHOLD = 3
PAIRS_AT_ONCE = 1 << 18
COMMON = 1 << 18  # shingles whose counts order the prefixes
FORESTS = 2  # spanning forests of neighbours that are checked first
CROWD = 4096  # rows under one key that a task compares with each other
NEIGHBOURS = 8  # rows before it that a row of a crowd is compared with at first
DIGEST = ["d0", "d1"]  # of a set of shingles
SKETCH = 4  # parities for each shingle of a set, at least

_BITS31 = np.arange(31, dtype=np.int64)
#: Syndrome of each byte at each of the four places of a half; bit i of the low 31 counts as i + 1, bit 31 is free.
_SYNDROME = np.array([[np.bitwise_xor.reduce([8 * p + i + 1 for i in range(8) if v >> i & 1 and 8 * p + i < 31] or [0]) for v in range(256)] for p in range(4)], np.int64)


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of a UTF-8 text's shingles of width words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 14):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : min(at + (1 << 14), n)].tolist(), ends[at + k - 1 :].tolist())]
        counts += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            prints = [fingerprint(t, width) for t in _texts(part, 1)]
            yield pa.record_batch([part.column(0), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])


def syndrome(half: np.ndarray) -> np.ndarray:
    s = np.zeros(len(half), np.int64)
    for p in range(4):
        s ^= _SYNDROME[p][half >> 8 * p & 255]
    return s


def home(half: np.ndarray) -> np.ndarray:
    """The nearest anchor: at most one bit away."""
    s = syndrome(half)
    return np.where(s > 0, half ^ (1 << np.maximum(s - 1, 0)), half)


def near_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in half and anchors: all anchors within 2 bits of each half."""
    s, free = syndrome(half), 1 << 31
    at = np.arange(len(half))
    places, anchors = [at, at], [home(half), home(half) ^ free]
    off = np.flatnonzero(s)
    places[1] = at  # with the free bit flipped one more bit may differ, which the home uses up or leaves
    i = _BITS31[None, :] + 1
    j = i ^ s[off][:, None]
    row, col = np.nonzero((j > i) & (j <= 31))
    places.append(off[row])
    anchors.append(half[off[row]] ^ (1 << (i[0, col] - 1)) ^ (1 << (j[row, col] - 1)))
    return np.concatenate(places), np.concatenate(anchors)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 1 << 14):
            part = fp[at : at + (1 << 14)]
            for side in (0, 1):
                half = part >> 32 * side & 0xFFFFFFFF
                own = home(half)
                places, anchors = near_anchors(half)
                yield pa.record_batch([pa.array(anchors | side << 32, pa.int64()), pa.array(part[places], pa.int64()), pa.array(anchors == own[places])], names=["anchor", "fp", "home"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between each value and the smallest it reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def meetings(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of homes and of replicas at the same anchor, in blocks; home i meets n[i] replicas from first[i] on."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        for lo in range(0, int(n[at]) if to == at + 1 else 1, PAIRS_AT_ONCE):
            m = np.minimum(n[at:to] - lo, PAIRS_AT_ONCE) if to == at + 1 else n[at:to]
            starts = first[at:to] + lo - np.concatenate(([0], np.cumsum(m)[:-1]))
            yield np.repeat(np.arange(at, to), m), np.repeat(starts, m) + np.arange(m.sum())
        at = to


def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 1, most: int | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of rows, which come in order of their first keys columns, in parts that hold whole groups of equal keys; and
    the (single) keys of groups of more than most rows, of which the rows are left out."""
    rest, skipped = None, None
    for batch in batches:
        new = arrays(batch)
        if skipped is not None:
            new = [c[int(np.searchsorted(new[0], skipped, "right")) :] for c in new]
        if not len(new[0]):
            continue
        rest, skipped = new if rest is None else [np.concatenate(x) for x in zip(rest, new)], None
        changed = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in rest[:keys]])) + 1
        last = int(changed[-1]) if len(changed) else 0
        crowds = np.zeros(0, np.int64)
        if most is not None:
            sizes = np.diff(np.concatenate(([0], changed, [len(rest[0])])))
            crowds = rest[0][np.concatenate(([0], changed))][sizes > most]
            if len(crowds) and crowds[-1] == rest[0][-1]:
                skipped = crowds[-1]
        ready = [c[:last] for c in rest]
        rest = [c[last:] for c in rest] if skipped is None else None
        if len(crowds):
            stay = ~np.isin(ready[0], crowds)
            ready = [c[stay] for c in ready]
        if len(ready[0]) or len(crowds):
            yield ready, crowds
        pa.default_memory_pool().release_unused()
    if rest is not None and len(rest[0]):
        yield rest, np.zeros(0, np.int64)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows of which a key's follow each other, and places of pairs of the same key, NEIGHBOURS apart at most."""
    tail = None
    for batch in batches:
        rows = arrays(batch)
        old = 0 if tail is None else len(tail[0])
        rows = rows if tail is None else [np.concatenate(x) for x in zip(tail, rows)]
        later = [np.arange(max(old, step), len(rows[0])) for step in range(1, NEIGHBOURS + 1)]
        i, j = np.concatenate(later), np.concatenate([x - step for step, x in enumerate(later, 1)])
        same = rows[0][i] == rows[0][j]
        yield rows, i[same], j[same]
        tail = [c[-NEIGHBOURS:] for c in rows]


def _block_pairs(batches: Iterator[pa.RecordBatch], test: Callable) -> Iterator[pa.RecordBatch]:
    """Of each block (key, k, m) the pairs of a row of side 1 and one of side 0 that pass test and have other roots."""
    for rows, _ in whole_groups(batches, 3):
        key, k, m, side, node, root, *more = rows
        group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (k[1:] != k[:-1]) | (m[1:] != m[:-1]))))
        right = np.flatnonzero(side == 1)
        first = np.searchsorted(group, group[right])
        left = np.bincount(group[side == 0], minlength=int(group[-1]) + 1)[group[right]]
        for at, j in meetings(first, left):
            i = right[at]
            near = root[i] != root[j]
            i, j = i[near], j[near]
            near = test(more, i, j)
            a, b = node[i[near]], node[j[near]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def across(rows: DataFrame, test: Callable) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different roots that share a key and pass test, for keys that crowds share.

    rows: (key, node, root, ...); test gets the other columns and places of pairs. Of two roots one isn't the key's most
    frequent: rows of other roots are compared with all, in blocks of about CROWD rows by CROWD, each a group of its own."""
    more = [c for c in rows.columns if c not in ("key", "node", "root")]
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("most")).where("total > most")
    blocks = main.select("key", "main", F.ceil(F.col("total") / CROWD).cast("int").alias("ks"), F.ceil((F.col("total") - F.col("most")) / CROWD).cast("int").alias("ms"))
    marked = even_join(rows, blocks, ["key"])
    dealt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = marked.select("key", dealt("ks", 1).alias("k"), every("ms").alias("m"), F.lit(0).alias("side"), "node", "root", *more)
    right = marked.where("root <> main").select("key", every("ks").alias("k"), dealt("ms", 2).alias("m"), F.lit(1).alias("side"), "node", "root", *more)
    both = left.unionByName(right).repartition("key", "k", "m").sortWithinPartitions("key", "k", "m", "side")
    return durable(both.mapInArrow(partial(_block_pairs, test=test), "a long, b long").distinct(), "across")  # a plan of its own


def _apart(more: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Pairs of fingerprints of which one is at home, that differ in at most threshold bits."""
    fp, home_ = more
    return (home_[i] | home_[j]) & (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= threshold)


def _links(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """A forest of each task's links (a, b), and anchors that are too crowded for it (crowd)."""
    none = np.zeros(0, np.int64)
    for (anchor, fp, own), crowds in whole_groups(batches, 1, CROWD):
        homes = np.flatnonzero(own)
        first, last = np.searchsorted(anchor, anchor[homes]), np.searchsorted(anchor, anchor[homes], "right")
        a, b = none, none
        for at, j in meetings(first, last - first):
            i = homes[at]
            near = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= threshold) & (fp[i] != fp[j])
            if near.any():
                a, b = forest(np.concatenate((a, fp[i[near]])), np.concatenate((b, fp[j[near]])))
        n, c = len(a), len(crowds)
        yield pa.record_batch([pa.array(np.concatenate((x, y)), pa.int64(), mask=np.arange(n + c) >= n if k < 2 else np.arange(n + c) < n) for k, (x, y) in enumerate(((a, crowds), (b, crowds), (np.zeros(n, np.int64), crowds)))], names=["a", "b", "crowd"])


def _neighbour_links(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for (_, fp, own), i, j in neighbours(batches):
        near = _apart([fp, own], i, j, threshold)
        a, b = forest(fp[i[near]], fp[j[near]])
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def near_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that connect whatever links among prints (fp long): a forest from each task, not all pairs."""
    if not 0 <= threshold <= 3:
        raise ValueError("the anchors cover thresholds from 0 to 3")
    replicas = prints.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean")
    found = durable(replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(partial(_links, threshold=threshold), "a long, b long, crowd long"), "links")
    links, crowded = found.where("crowd is null").select("a", "b"), found.where("crowd is not null").select(F.col("crowd").alias("anchor")).distinct()
    if crowded.isEmpty():
        return links.distinct()
    rows = durable(replicas.join(crowded, "anchor", "left_semi"), "crowds")
    near = rows.repartitionByRange("anchor", "fp").sortWithinPartitions("anchor", "fp").mapInArrow(partial(_neighbour_links, threshold=threshold), "a long, b long")
    roots = components(links.union(near), "links")
    rooted = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.col("anchor").alias("key"), F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"), "fp", "home")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across(rooted, partial(_apart, threshold=threshold)))


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, fp long) for every row, as a durable table."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return durable(docs.select("doc_id", "text").mapInArrow(partial(_prints, width=width), f"doc_id {kind}, fp long"), "simhash")


def near_dedup(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links) for every row."""
    prints = fingerprints(docs, width)
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(near_links(nodes, threshold), "links").select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = durable(placed, "placed")
    named = even_join(placed, placed.groupBy("root").agg(F.min("least").alias("component_id")), ["root"]).select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return even_join(prints, named, ["fp"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


# Near-duplicates by similarity


def _shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of the set of a text's shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(width, len(words))
    each, n = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64), len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ h >> np.uint64(31))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    return (t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist())


def _repeated(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Shingles of more than one text among those a task counts at once, and of how many."""
    parts, size = [], 0

    def counted() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
        return pa.record_batch([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

    for text in (t for batch in batches for part in slices(batch, 0) for t in _texts(part, 0)):
        parts.append(_shingles(text, width))
        size += len(parts[-1])
        if size > 1 << 22:
            yield counted()
            parts, size = [], 0
    yield counted()


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of most texts, COMMON at most, sorted, and a count of texts for each. They set the order
    of prefixes alone: which ones are known makes prefixes cheaper, never wrong."""
    counts = docs.select("text").mapInArrow(partial(_repeated, width=width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8")
    counts = durable(counts, "common")
    level, left = 62, COMMON
    for row in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect():  # 63 rows at most
        left -= row["count"]
        if left < 0:
            break
        level = row["level"]
    rows = counts.where(F.col("n") >= 1 << level).toArrow()  # COMMON rows at most
    token, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, similarity: float, common: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each text: fingerprint, digest of its set of shingles, size, parities of the hashes' places in 128 bits, prefix and sketch."""
    for batch in (part for whole in batches for part in slices(whole, 1)):
        whole, prints, digests, sizes, bits, prefixes, sketches = [], [], [], [], [], [], []
        for text in _texts(batch, 1):
            s = _shingles(text, width)
            n, first = len(s), s
            if len(common) and n:
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                known = common[at] == s
                if known.any():
                    first = s[np.argsort(np.where(known, counts[at], 0), kind="stable")]
            whole.append(xxhash.xxh64_intdigest(text, SEED))
            prints.append(fingerprint(text, width))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sizes.append(n)
            bits.append(np.packbits(np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128).astype(np.uint8) & 1).tobytes())
            sketches.append(_sketch(s))
            prefixes.append(first[: n - math.ceil(similarity * n - 1e-9) + 1 if n else 0].tobytes())
        d, b = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2).T.copy() for x in (digests, bits))
        long = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
        columns = [batch.column(0), long(whole), long(prints), *map(pa.array, d), pa.array(np.array(sizes, np.int32)), *map(pa.array, b), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "whole", "fp", *DIGEST, "n", "b0", "b1", "prefix", "sketch"])


def _replicate(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each prefix, with its place and whether it is one of hot."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 1 << 10):
            batch = whole.slice(lo, 1 << 10)
            prefixes = batch.column(0).to_pylist()
            length = np.array([len(p) // 8 for p in prefixes], np.int64)
            at = np.repeat(np.arange(len(length)), length)
            place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
            columns = [c.take(pa.array(at)) for c in batch.columns[1:]]
            token = np.frombuffer(b"".join(prefixes), np.int64)
            crowded = pa.array(np.isin(token, hot)) if len(hot) else pa.array(np.zeros(len(token), bool))
            yield pa.record_batch([pa.array(token), *columns, pa.array(place.astype(np.int32)), crowded], names=["key", *batch.schema.names[1:], "place", "hot"])


REPLICAS = "key long, node long, root long, n int, b0 long, b1 long, place int, hot boolean"


def lightest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links of the lightest spanning forest; ties go by a and b."""
    order = np.lexsort((b, a, weight))
    nodes, at = np.unique(np.concatenate((a[order], b[order])), return_inverse=True)
    x, y, root = at[: len(order)], at[len(order) :], np.arange(len(nodes))
    chosen, live = np.zeros(len(order), bool), np.arange(len(order))
    while True:
        live = live[root[x[live]] != root[y[live]]]
        if not len(live):
            return order[chosen]
        best = np.full(len(nodes), len(order))  # of each tree so far, its lightest link to another one
        np.minimum.at(best, root[x[live]], live)
        np.minimum.at(best, root[y[live]], live)
        take = np.unique(best[best < len(order)])
        chosen[take] = True
        while (root[x[take]] != root[y[take]]).any():
            rx, ry = root[x[take]], root[y[take]]
            low = np.minimum(rx, ry)
            np.minimum.at(root, rx, low)
            np.minimum.at(root, ry, low)
            while (root[root] != root).any():
                root = root[root]


def forests(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links of FORESTS lightest spanning forests, each of what the ones before left."""
    kept, rest = [], np.arange(len(a))
    for _ in range(FORESTS):
        if len(rest):
            found = lightest(a[rest], b[rest], weight[rest])
            kept.append(rest[found])
            rest = np.delete(rest, found)
    return np.concatenate(kept) if kept else rest


def _can(more: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs can be as similar. Nothing is left out but what can't: by size and the shingles left after the shared
    one, and as sets differ by as many shingles at least as parities."""
    n, b0, b1, place = (x.astype(np.int64, copy=False) for x in more)
    total = n[i] + n[j]
    need = np.ceil(similarity / (1 + similarity) * total - 1e-9)
    can = np.minimum(n[i] - place[i], n[j] - place[j]) >= need
    can &= total - _parity(b0, b1, i, j) >= 2 * need
    return can


def _parity(b0: np.ndarray, b1: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count((b0[i] ^ b0[j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((b1[i] ^ b1[j]).view(np.uint64))


def _distinct(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Pairs in order, each once."""
    order = np.lexsort((b, a))
    columns = [x[order] for x in (a, b, *more)]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return [x[new] for x in columns]


def _told(kinds: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (a, b) of several kinds, in the order of the constants below; one value stands in both columns."""
    kind = np.repeat(np.arange(len(kinds)), [len(a) for a, _ in kinds]).astype(np.int32)
    return pa.record_batch([pa.array(np.concatenate([x[c] for x in kinds]), pa.int64()) for c in (0, 1)] + [pa.array(kind)], names=["a", "b", "kind"])


PAIR, REST, NODE, CROWDED = 0, 1, 2, 3  # pairs to check first, other pairs, nodes of larger groups, keys of crowds


def _near_pairs(more: list[np.ndarray], node: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, whole: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of pairs that can be as similar FORESTS forests of the likest, and those of the others for which whole holds."""
    can = _can(more, i, j, similarity)
    i, j, whole = i[can], j[can], whole[can]
    a, b, weight, whole = _distinct(np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), _parity(more[1], more[2], i, j), whole)
    stay = np.zeros(len(a), bool)
    stay[forests(a, b, weight)] = True
    rest = whole & ~stay
    return (a[stay], b[stay]), (a[rest], b[rest])


def _first_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of keys that up to NEIGHBOURS + 1 rows share all pairs that can be as similar; of larger ones only forests of neighbours in
    order of size, and their nodes; of crowds the key."""
    none = np.zeros(0, np.int64)
    for (key, node, _, n, b0, b1, place), crowds in whole_groups(batches, 1, CROWD):
        first, rest, nodes = (none, none), (none, none), none
        if len(key):
            group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            large = (np.bincount(group) > NEIGHBOURS + 1)[group]
            steps = [np.flatnonzero(group[step:] == group[:-step]) + step for step in range(1, min(NEIGHBOURS, len(key) - 1) + 1)]
            if steps:
                i, j = np.concatenate(steps), np.concatenate([x - step for step, x in enumerate(steps, 1)])
                first, rest = _near_pairs([n, b0, b1, place], node, i, j, similarity, ~large[i])
            nodes = np.unique(node[large])
        yield _told([first, rest, (nodes, nodes), (crowds, crowds)])


def _neighbour_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours in a crowd, in order of size, that can be as similar: FORESTS forests of the likest."""
    for (_, node, _, n, b0, b1, place), i, j in neighbours(batches):
        (a, b), _ = _near_pairs([n, b0, b1, place], node, i, j, similarity, np.zeros(len(i), bool))
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _other_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """All pairs of different roots that can be as similar, of keys that more than NEIGHBOURS + 1 rows share, but for crowds."""
    none = np.zeros(0, np.int64)
    for rows, _ in whole_groups(batches, 1, CROWD):
        a, b = none, none
        if len(rows[0]):
            group = np.cumsum(np.concatenate(([0], rows[0][1:] != rows[0][:-1])))
            lowest, highest = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(lowest, group, rows[2])
            np.maximum.at(highest, group, rows[2])
            some = ((lowest < highest) & (np.bincount(group) > NEIGHBOURS + 1))[group]  # others are of one root, or done
            group, (node, root, n, b0, b1, place) = group[some], (x[some].astype(np.int64) for x in rows[1:])
            last = np.searchsorted(group << 32 | n, group << 32 | np.floor(n / similarity + 1e-9).astype(np.int64), "right")
            first = np.arange(len(n)) + 1
            for i, j in meetings(first, np.maximum(last - first, 0)):
                other = root[i] != root[j]
                i, j = i[other], j[other]
                can = _can([n, b0, b1, place], i, j, similarity)
                i, j = i[can], j[can]
                a, b = _distinct(np.concatenate((a, np.minimum(node[i], node[j]))), np.concatenate((b, np.maximum(node[i], node[j]))))
                if len(a) > PAIRS_AT_ONCE:
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b = none, none
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles at each place; places are SKETCH times as many as shingles, or more, and a power of two."""
    places = 1 << max(7, (SKETCH * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1).tobytes()


def _unlike(a: bytes, b: bytes) -> int:
    """By how many shingles two sets differ at least: places of other parity. Places of the larger sketch fold to those of the other."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _could(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, and the sizes and sketches of both) whose sketches leave it open that they are as similar."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a_n", "b_n"))
        need = 2 * np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
        differ = np.fromiter((_unlike(x.as_py(), y.as_py()) for x, y in zip(batch.column("a_sketch"), batch.column("b_sketch"))), np.int64, batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(n + m - differ >= need))


def _verified(batches: Iterator[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Which pairs (a, b, and their texts) have sets of shingles of that Jaccard similarity."""
    for batch in batches:
        stay, known = [], (None, None)
        for at in range(batch.num_rows):  # one pair's texts at a time
            raw = [batch.column(c)[at].as_py() for c in (0, 2, 3)]
            if raw[0] != known[0]:
                known = raw[0], _shingles(raw[1].encode("utf-8", "surrogatepass"), width)
            x, y = known[1], _shingles(raw[2].encode("utf-8", "surrogatepass"), width)
            both = len(np.intersect1d(x, y, assume_unique=True))
            stay.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        yield batch.select([0, 1]).filter(pa.array(stay, pa.bool_()))
        pa.default_memory_pool().release_unused()


def _printed_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by near_links of their fingerprints: every node of a fingerprint with its first one, and the first ones
    of fingerprints that link."""
    heads = durable(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = even_join(nodes.select("fp", "node"), heads, ["fp"]).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    linked = even_join(even_join(near_links(heads.select("fp")), head("a"), ["a"]), head("b"), ["b"])
    ends = F.col("a_head"), F.col("b_head")
    return same.union(linked.where("a_head <> b_head").select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id, by links of documents whose sets of shingles have that Jaccard similarity or more.

    SimHash comes first: texts whose fingerprints link by their anchors are checked on their whole sets before others. What
    differs in more bits, as most pairs just above the similarity do, is found by prefixes, without exception: of two sets of that similarity, each in one order (common shingles
    last), the first n - ceil(similarity * n) + 1 share a shingle. Spanning forests of the likest pairs are checked first, which
    unite most groups; then every other pair between different components: those under a shingle that few sets share are
    kept from the first pass, those under others are made in a second one, of the sets that have such shingles. Sketches of as many
    bits as a set needs rule out most of these before texts move to them. Rows under a shingle of a crowd, known from the counts or told by the task that meets it, are
    dealt out in blocks (across). Shingles are compared as 64-bit hashes; texts of equal sets are one node.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    common, counts = common_shingles(docs, width)
    prefixes = partial(_prefixes, width=width, similarity=similarity, common=common, counts=counts)
    found = durable(docs.select("doc_id", "text").mapInArrow(prefixes, f"doc_id {kind}, whole long, fp long, d0 long, d1 long, n int, b0 long, b1 long, prefix binary, sketch binary"), "prefixes")
    nodes = found.groupBy(*DIGEST).agg(F.min(F.struct("doc_id", "whole", "fp")).alias("c"), *(F.first(c).alias(c) for c in ("n", "b0", "b1", "prefix", "sketch")))
    nodes = nodes.select(*DIGEST, F.col("c.doc_id").alias("least"), "c.whole", "c.fp", "n", "b0", "b1", "prefix", "sketch")
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    ids = durable(found.select("doc_id", *DIGEST), "ids")
    discard(found)
    settle(docs.sparkSession)
    hot = common[counts > CROWD].view(np.int64)

    def replicated(rooted: DataFrame) -> DataFrame:
        return rooted.select("prefix", "node", "root", "n", "b0", "b1").mapInArrow(partial(_replicate, hot=hot), REPLICAS)

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "n", "node")

    def open_(links: DataFrame) -> DataFrame:
        """Links that sketches don't rule out: of texts that are alike, but less than similarity, most don't get past this."""
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
        both = even_join(even_join(links, side("a"), ["a"]), side("b"), ["b"]).select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch")
        return durable(both.mapInArrow(partial(_could, similarity=similarity), "a long, b long"), "open")

    def verified(links: DataFrame) -> DataFrame:
        ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        named = durable(marked(nodes, F.col("node"), ends).join(ends, "node").select("node", F.col("least").alias("id"), F.col("whole").alias("digest")), "ends")
        text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("whole", F.xxhash64("text"))
        text = marked(text, F.col("whole"), named.select("digest"))
        texts = text.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("whole") == F.col("digest"))).groupBy("node").agg(F.first("text").alias("text"))
        texts = durable(texts, "texts")
        settle(docs.sparkSession)
        side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
        both = even_join(even_join(links, side("a"), ["a"]), side("b"), ["b"])  # texts move, which are smaller than their shingles
        alike = durable(both.select("a", "b", "a_text", "b_text").mapInArrow(partial(_verified, width=width, similarity=similarity), "a long, b long"), "alike")
        discard(named, texts)
        settle(docs.sparkSession)
        return alike

    each = replicated(nodes.withColumn("root", F.col("node")))
    cold, crowds = each.where("not hot").drop("hot"), [each.where("hot").drop("hot")] if len(hot) else []
    marks = durable(hashed(cold).mapInArrow(partial(_first_pairs, similarity=similarity), "a long, b long, kind int"), "candidates")
    settle(docs.sparkSession)
    pairs = lambda kind: marks.where(F.col("kind") == kind)
    if told := not pairs(CROWDED).isEmpty():
        keys = durable(pairs(CROWDED).select(F.col("a").alias("key")).distinct(), "keys")
        crowds.append(cold.join(keys, "key", "left_semi"))
    first = [_printed_pairs(nodes.select("fp", "node")), pairs(PAIR).select("a", "b")]
    if crowds:
        crowd = durable(reduce(DataFrame.unionByName, crowds), "crowds")
        near = crowd.repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node")
        first.append(near.mapInArrow(partial(_neighbour_pairs, similarity=similarity), "a long, b long"))
    checked = durable(reduce(DataFrame.union, first).distinct(), "pairs")
    roots = components(verified(checked), "similar")
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rest = pairs(REST).select("a", "b").distinct().join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    rest = rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    wanted = pairs(NODE).select(F.col("a").alias("node")).distinct()
    large = marked(nodes, F.col("node"), wanted).join(wanted, "node").select("node", "n", "b0", "b1", "prefix")  # a semi join would go before the bitmap
    rooted = replicated(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))).where("not hot").drop("hot")
    rooted = rooted.join(keys, "key", "left_anti") if told else rooted
    others = made = durable(hashed(rooted).mapInArrow(partial(_other_pairs, similarity=similarity), "a long, b long").union(rest), "others")
    settle(docs.sparkSession)
    if crowds:
        again = crowd.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        others = others.union(across(durable(again.select("key", "node", "root", "n", "b0", "b1", "place"), "crowds"), partial(_can, similarity=similarity)))
    others = durable(others.distinct().join(checked, ["a", "b"], "left_anti"), "candidates")
    discard(marks, checked, made)
    settle(docs.sparkSession)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(open_(others))), "similar")
    discard(others)
    placed = durable(nodes.select(*DIGEST, "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    named = even_join(placed, placed.groupBy("root").agg(F.min("least").alias("component_id")), ["root"]).select(*DIGEST, "component_id")
    return even_join(ids, named, DIGEST).select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, with one row of each group of similar_groups, whatever its doc_id: that of the first doc_id and digest.
    Rows that repeat both are one; of them that of the smallest hash stays. Whole rows move once."""
    key = F.concat_ws(":", F.lpad(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), 20, "0"), F.sha2(F.coalesce("text", F.lit("")), 256))
    found = similar_groups(docs.select(key.alias("doc_id"), "text"), width, similarity)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    keyed = docs.select(key.alias("key"), same_rows(docs).alias("tie"), whole_row(docs).alias("row"))
    first = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("tie"))).where("nth = 1")
    return first.join(stay, "key", "left_semi").select("row.*")


keep_one_row = keep_one
