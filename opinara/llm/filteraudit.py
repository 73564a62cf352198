"""What each of five filters removes, in every order: a CUBE of failure flags gives the survivors of every subset of filters."""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import discard, durable, even_join

FILTERS = "ABCDE"
_ALL = 2 ** len(FILTERS) - 1
_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"
_COUNTS = ("docs", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters on a text alone, by letter: true where it fails. A null counts as empty; an empty text fails A only."""
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(_SPACES))
    words = F.when(F.length(bare) > 0, F.split(bare, _SPACE)).otherwise(F.array().cast("array<string>"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents of each part fail which filters: (part, A, B, C, D, E, docs, good, toxic), a row for each combination.

    E is true where a row of a smaller doc_id has the same text (a row without doc_id is never a later copy; rows that share the
    smallest doc_id are all first). Texts move as SHA-256. The other flags belong to the text, so rows of one text are counted by
    part and label first, with their smallest doc_id and how many rows have it: crowds of copies meet as counts.
    """
    marks = {"is_good": F.expr("coalesce(quality = 1, false)"), "is_toxic": F.expr("coalesce(toxic = 1, false)")}
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(*(F.max(c).alias(n) for n, c in marks.items()))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), *(c.alias(n) for n, c in text_failures(F.col("text")).items()),
    )
    rows = rows.join(known, F.col("id") == F.col("labelled"), "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in marks})
    same = ["digest", "part", *marks, *"ABCD"]
    once = rows.groupBy("id", *same).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    crowds = durable(once.groupBy(*same).agg(F.sum("n").alias("n"), least.alias("least"), nameless.alias("nameless")), "crowds")
    first = crowds.groupBy("digest").agg(F.min("least.id").alias("first"))
    ours = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("nameless")
    split = F.array(F.struct(F.lit(False).alias("E"), ours.alias("docs")), F.struct(F.lit(True).alias("E"), (F.col("n") - ours).alias("docs")))
    both = even_join(crowds, first, ["digest"]).select("part", *"ABCD", *marks, F.inline(split)).where("docs > 0")
    counted = both.groupBy("part", *FILTERS).agg(
        F.sum("docs").alias("docs"), *(F.sum(F.when(F.col(m), F.col("docs")).otherwise(0)).alias(n) for m, n in zip(marks, _COUNTS[1:]))
    )
    result = durable(counted, "failures")
    discard(crowds)
    return result


def survivors(counted: DataFrame) -> DataFrame:
    """(part, total, mask, docs, good, toxic): what stays of a part under each subset of the filters, as bits of mask. A grouping
    set of the cube names a subset; its row whose flags are all false counts the survivors, and where there is none, none stay.
    Rows with total are of all parts together."""
    cube = counted.cube("part", *FILTERS).agg(
        *(F.sum(c).alias(c) for c in _COUNTS), F.grouping("part").alias("total"),
        sum(((1 - F.grouping(f)) * 2**i for i, f in enumerate(FILTERS)), F.lit(0)).cast("int").alias("mask"),
    )
    stay = cube.where(~F.coalesce(F.greatest(*FILTERS), F.lit(False))).select(F.coalesce("part", F.lit("")).alias("part"), "total", "mask", *_COUNTS)
    wanted = _parts(counted).select("part", "total", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("mask"))
    return wanted.join(stay, ["part", "total", "mask"], "left").fillna(0, list(_COUNTS))


def _parts(counted: DataFrame) -> DataFrame:
    """The parts, and one more row for their total."""
    parts = counted.select("part", F.lit(0).cast("byte").alias("total")).distinct()
    return parts.union(counted.groupBy(F.lit("").alias("part"), F.lit(1).cast("byte").alias("total")).agg(F.count("*")).select("part", "total"))


def _literal(rows: list[tuple], fields: str) -> Column:
    """Rows of constants, beside each row of a table; fields as in a schema."""
    names = [f.split()[0] for f in fields.split(", ")]
    return F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{fields}>>"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (source; null: empty), each order of the filters A to E and each step of it.

    docs: doc_id, text, source; labels: doc_id, quality, toxic (a document counts as good or toxic if any of its rows says so);
    further columns are left aside. Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley, and kept_all, the kept of all parts together. Nulls and empty texts fail A; repeated rows count each;
    an empty table gives no rows. Texts of any length are read whole; the rest of the work is on counts.
    """
    counted = failures(docs, labels)
    stay = durable(survivors(counted), "survivors")
    weight = [math.factorial(k) * math.factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]  # orders in which k given filters come before
    edges = [(m, m | 2**i, f, weight[m.bit_count()]) for i, f in enumerate(FILTERS) for m in range(_ALL + 1) if not m >> i & 1]
    pairs = stay.where("mask = 0").select("part", "total", _literal(edges, "before int, after int, letter string, weight int"))
    left = stay.select("part", "total", F.col("mask").alias("before"), *(F.col(c).alias(f"{c}_before") for c in _COUNTS))
    right = stay.select("part", "total", F.col("mask").alias("after"), *(F.col(c).alias(f"{c}_after") for c in _COUNTS))
    pairs = pairs.join(left, ["part", "total", "before"]).join(right, ["part", "total", "after"])
    lost = {c: F.col(f"{c}_before") - F.col(f"{c}_after") for c in _COUNTS}
    pairs = pairs.select("part", "total", "letter", "before", "after", "weight", F.col("docs_after").alias("kept"), *(c.alias(n) for n, c in lost.items()))
    alone = F.when(F.col("before") == 0, F.col("docs"))
    last = F.when(F.col("after") == _ALL, F.col("docs"))
    share = F.sum(F.col("docs") * F.col("weight")).alias("shapley")
    each = pairs.groupBy("part", "total", "letter").agg(F.max(alone).alias("fails"), F.max(last).alias("unique_fails"), share)
    orders = [
        ("".join(FILTERS[i] for i in order), k + 1, FILTERS[order[k]], sum(2**i for i in order[:k]))
        for order in itertools.permutations(range(len(FILTERS)))
        for k in range(len(FILTERS))
    ]
    everywhere = pairs.where("total = 1").select("letter", "before", F.col("kept").alias("kept_all"))
    steps = stay.where("mask = 0 and total = 0").select("part", "total", _literal(orders, "filter_order string, step int, letter string, before int"))
    steps = steps.join(pairs, ["part", "total", "letter", "before"]).join(each, ["part", "total", "letter"]).join(F.broadcast(everywhere), ["letter", "before"])
    return steps.select(
        "part", "filter_order", "step", "kept", F.col("docs").alias("removed"), (F.col("fails") - F.col("docs")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley", "kept_all",
    )
