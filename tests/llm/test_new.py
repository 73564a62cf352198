"""The audit of filters, vector codes and main texts against plain versions."""

import hashlib
import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.llm import filteraudit, vectorcodes
from tests.llm.conftest import make


def plain_audit(docs, labels):
    """docs: (doc_id, text, source) rows; labels: (doc_id, quality, toxic) rows."""
    seen, rows = {}, []
    for i, text, _ in docs:
        if i is not None:
            seen[text or ""] = min(i, seen.get(text or "", i))
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and seen[text] < i,
        }
        rows.append((source or "", fails, any(None != d == i and q == 1 for d, q, _ in labels), any(None != d == i and t == 1 for d, _, t in labels)))
    found, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                out = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                late = sum(r[1][f] for r in rows if r[0] == part) - len(out)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows if r[0] == part)
                found[part, order, step] = (len(left), len(out), late, only, sum(r[2] for r in out), sum(r[3] for r in out))
                removed_by[part, f] = removed_by.get((part, f), 0) + len(out)
    return {(p, o, s): (*v, removed_by[p, o[s - 1]]) for (p, o, s), v in found.items()}


def audited(docs, labels):
    rows = filteraudit.audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found, rows


def test_audit_is_the_plain_one(spark, both):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (100_003, 1, 1), (40, 1, 0), (41, 0, 1)]
    wide = both.selectExpr("doc_id", "text", "case when doc_id % 3 = 0 then null when doc_id % 7 = 0 then '' else source end AS source", "1 AS A", "lang AS part", "2 AS n")
    wide = wide.union(spark.createDataFrame([(None, "A b c", "x", 1, "p", 2), (None, None, None, 1, "p", 2)], wide.schema))
    found, rows = audited(wide, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS is_good", "2 AS id"))
    assert found == plain_audit([(r.doc_id, r.text, r.source) for r in wide.collect()], labels)
    for r in rows[:50]:
        assert r.kept_all == sum(v[0] for (_, o, s), v in found.items() if (o, s) == (r.filter_order, r.step))


def test_audit_of_an_empty_table_and_of_one_crowd(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(empty, none).count() == 0
    found, _ = audited(make(spark, ["same"] * 300), none)
    assert found["s", "EABCD", 1] == (1, 299, 0, 0, 0, 0, 299 * 24 * 5 // 2)


def test_text_failures_at_their_bounds(spark):
    texts = ["w " * 199, " ".join(map(str, range(200))), "a b a b", "a b a c a", "A" + "b" * 49, "A" + "b" * 48, "fifty|", "\x0bé\xa0é"]
    rows = make(spark, texts).select("doc_id", *(c.alias(n) for n, c in filteraudit.text_failures(F.col("text")).items())).collect()
    got = {r.doc_id: "".join(k for k in "ABCD" if r[k]) for r in rows}
    assert got == {0: "AB", 1: "", 2: "A", 3: "A", 4: "A", 5: "AC", 6: "AD", 7: "A"}


def plain_codes(rows):
    """rows: (vec_id, vector, label) of one dimension, all finite."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1])
    part = max(1, -(-width // 8))
    whole = [[math.floor(Fraction(x) * 4096) for x in v] + [0] * (8 * part - width) for _, v, _ in rows]
    parts = [[v[p * part : (p + 1) * part] for p in range(8)] for v in whole]
    books = [[v[p] for v in parts[:16]] for p in range(8)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            members = {}
            for v in parts:
                members.setdefault(nearest(v[p], book)[1], []).append(v[p])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i])] if i in members else e for i, e in enumerate(book)]
    out = []
    for (i, _, label), v in zip(rows, parts):
        found = [nearest(v[p], books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {k: min(sum(min(r[2], 2**63 - 1) for r in out if r[3] == k), 2**63 - 1) for k in {r[3] for r in out}}
    return [(i, c, min(e, 2**63 - 1), total[k], digest) for i, c, e, k in out]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'x' AS code", "1 AS none", "2 AS same")


def coded(df):
    return sorted((tuple(r) for r in vectorcodes.compress(df).collect()), key=str)


@pytest.mark.parametrize("width, scale, kind", [(64, 1.0, "float"), (10, 0.001, "float"), (3, 1e30, "float"), (9, 1e307, "double"), (0, 1.0, "float")])
def test_codes_are_the_plain_ones(spark, width, scale, kind):
    rng = np.random.default_rng(width)
    values = (rng.normal(size=(60, width)) * scale).astype(np.float32 if kind == "float" else np.float64)
    rows = [(None if i % 20 == 19 else i // 2, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(values)] + [(100 + i, values[3].tolist(), 1) for i in range(20)]
    assert coded(vectors(spark, rows, kind).repartition(3)) == sorted(plain_codes(rows), key=str)


def test_codes_leave_out_what_no_codebook_fits(spark):
    good = [(i, [float(i), -1.5, 0.25], i % 2) for i in range(1, 6)]
    bad = [(0, None, 1), (-1, [1.0, None, 2.0], 1), (-2, [float("nan"), 1.0, 1.0], 1), (-3, [1.0, float("-inf"), 1.0], 0), (9, [1.0], 1), (None, [], 1)]
    assert coded(vectors(spark, good + bad)) == sorted(plain_codes(good), key=str)
    assert coded(vectors(spark, bad[:4])) == [] == coded(vectors(spark, []))


def test_bounds_hold_and_codes_decode(spark):
    rows = [(i, [math.sin(i * j) for j in range(16)], 0) for i in range(50)]
    kept, width = vectorcodes.usable(vectors(spark, rows))
    books = vectorcodes.fit(kept, width)
    block = vectorcodes.integers(np.array([r[1] for r in rows]))
    best, error = books.nearest(block)
    for far in (block, block * 1e6):  # beyond what float64 holds exactly
        best, error = books.nearest(far)
        whole = [[[sum((int(a) - b) ** 2 for a, b in zip(v, e)) for e in book] for v, book in zip(row, books.entries)] for row in far]
        assert best.tolist() == [[d.index(min(d)) for d in row] for row in whole] and [[int(x) for x in r] for r in error] == [[min(d) for d in r] for r in whole]
    for r in vectorcodes.decode(vectorcodes.encode(kept, width, books), books, width).collect():
        gap = sum((math.floor(a * 4096) - b * 4096) ** 2 for a, b in zip(np.float32(rows[r.vec_id][1]).tolist(), r.decoded))
        assert gap == r.error
