"""Canonical exact fingerprints of documents, by DataFrame functions alone.

A text's canonical form is its NFKC normal form with case folded and runs of white space made one space (Spark ships the ICU
library, whose static functions java_method calls). Its fingerprint is 128 bits of xxhash, under two seeds, in hexadecimal.
Texts whose canonical forms share a fingerprint are compared byte by byte: the distinct forms of all buckets of two or more
rows are counted, and where a bucket has several, the form's SHA-256 is appended. Which rows need that is told by a
bitmap of fixed size (`marked`), which lets through all of them and, by chance, some others.

Edited texts are never stored: their forms are told apart, from each other and from the documents' own, by SHA-256.

Likeness of fingerprints is 1 where they are equal, else 0: an exact digest knows no degrees.

Defined results: null text counts as empty. Documents follow each other by falling doc_id, null ones last, and those of one
doc_id by a hash of their text; rows that share doc_id and text are one document, each with its row. After the last
document comes the first; a lone document follows itself. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.common import durable, even_join, marked

NO_ID = -(1 << 63)


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again; runs of white space as one space, none at the ends."""
    compose = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    plain = F.octet_length(text) == F.length(text)
    folded = F.when(plain, F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.trim(F.regexp_replace(folded, r"(?U)[\s\p{Z}\x1C-\x1F]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits: xxhash64 under two seeds."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), canon)), 16, "0")))


def raw_hash(text: Column) -> Column:
    return F.xxhash64(text)


def collisions(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """Fingerprints that stand for several canonical forms. texts: (text); prints: (print, raw) of each of its rows, raw being
    a hash of the text as it is, which tells the rows of shared fingerprints without making their form anew."""
    shared = even_join(prints, prints.groupBy("print").count().where("count > 1").select("print"), ["print"]).select("raw")
    text = F.coalesce("text", F.lit(""))
    near = marked(texts.select(text.alias("text")), raw_hash(F.col("text")), shared)
    forms = near.select(canonical(F.col("text")).alias("canon")).withColumn("print", wide_hash(F.col("canon")))
    return forms.distinct().groupBy("print").count().where("count > 1").select("print")


def verified(df: DataFrame, doubtful: DataFrame | None, print_: str, canon: str) -> DataFrame:
    """df with the SHA-256 of the canonical form behind fingerprints that stand for several forms."""
    if doubtful is None:
        return df
    mark = doubtful.select(F.col("print").alias(print_), F.lit(True).alias("_shared"))
    longer = F.when(F.col("_shared"), F.concat(print_, F.lit("-"), F.sha2(canon, 256))).otherwise(F.col(print_))
    return df.join(mark, print_, "left").withColumn(print_, longer).drop("_shared")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, canon) of every row: equal fingerprints are equal canonical forms."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", canonical(text).alias("canon"), raw_hash(text).alias("raw")).withColumn("fingerprint", wide_hash(F.col("canon")))
    doubtful = durable(collisions(docs.select("text"), rows.select(F.col("fingerprint").alias("print"), "raw")), "collisions")
    return verified(rows.drop("raw"), None if doubtful.isEmpty() else doubtful, "fingerprint", "canon")


KEY = ["id", "raw", "raw2"]  # of a document: its doc_id, and 128 bits of its text


def _followers(ids: DataFrame) -> DataFrame:
    """Of each document (KEY) its print and sha as next_print and next_sha, and the KEY of the document that it follows, as
    after_*, with n of that."""
    one = ids.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in ("n", "print", "sha"))).orderBy(F.col("id").desc(), "raw", "raw2")
    one = durable(one.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "order")
    parts = one.groupBy("part").agg(F.count("*").alias("rows"))  # a row for each partition
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = one.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("nth"))
    total = one.count()
    ahead = ranked.select(F.pmod(F.col("rank") + 1, F.lit(max(1, total))).alias("rank"), F.col("n").alias("after_n"), *(F.col(c).alias(f"after_{c}") for c in ("print", "sha", *KEY)))
    return ranked.select("rank", *KEY, F.col("print").alias("next_print"), F.col("sha").alias("next_sha")).join(ahead, "rank").drop("rank")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last third comes from the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = whole.select("id", raw_hash(F.col("text")).alias("raw"), F.xxhash64(F.lit(1), "text").alias("raw2"), "text")
    forms = texts.select(*KEY, F.length("text").alias("n"), canonical(F.col("text")).alias("canon"))
    ids = durable(forms.select(*KEY, "n", wide_hash(F.col("canon")).alias("print"), F.sha2("canon", 256).alias("sha")), "prints")
    follow = durable(_followers(ids), "followers")
    # both joins keep hot documents apart and share one exchange of the texts
    nexts = even_join(texts, follow, KEY).withColumn("start", F.expr("left(text, cast(after_n div 3 as int))"))
    nexts = nexts.select(*(F.col(f"after_{c}").alias(c) for c in (*KEY, "print", "sha")), "start", "next_print", "next_sha")
    if follow.count() < ids.count():  # rows that are one document bring the same start
        nexts = nexts.dropDuplicates(KEY)
    both = even_join(texts, nexts, KEY).withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - cut)"), F.expr("left(start, cut)")))
    both = both.select("id", "n_chars", "print", "sha", "next_print", "next_sha", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("edited")).alias("canon"))
    out = durable(both.withColumn("edited_print", wide_hash(F.col("canon"))).withColumn("edited_form", F.sha2("canon", 256)).drop("canon"), "edited")
    seen = out.select(F.col("edited_print").alias("print"), F.col("edited_form").alias("sha")).union(ids.select("print", "sha")).distinct()
    doubtful = seen.groupBy("print").count().where("count > 1").select("print").union(collisions(whole.select("text"), ids.select("print", "raw"))).distinct()
    doubtful = durable(doubtful, "collisions")
    told = lambda c, sha: F.col(c)
    if not doubtful.isEmpty():
        for c in ("print", "edited_print", "next_print"):
            out = even_join(out, doubtful.select(F.col("print").alias(c), F.lit(True).alias(f"{c}_shared")), [c], "left")
        told = lambda c, sha: F.when(F.col(f"{c}_shared"), F.concat(c, F.lit("-"), sha)).otherwise(F.col(c))
    own, edited, after = told("print", "sha"), told("edited_print", "edited_form"), told("next_print", "next_sha")
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        own.alias("fingerprint"),
        edited.alias("edited_fingerprint"),
        (own == edited).cast("double").alias("near_edited"),
        (own == after).cast("double").alias("near_next"),
    )
