import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, h string"


def make(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i if ids is None else ids[i], t, None, "s", None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [
    None,
    "",
    "   \t\n",
    "A b c",
    "a  b\tc",
    "A b c",
    "été STRASSE",
    "été straße",
    "\U0001f600 call +1 (555) 555-0100 or x.y@mail.example.com_z@b.org, ip 10.0.0.256 10.0.0.1.7",
    "4111 1111 1111 1111 and 1234567890123 token = \"24be64439e3e49cf46b2d7c90f3602a3\"",
    "Licensed under the Apache License, Version 2.0. MIT license; cc by gnu  General\nPublic license",
    "idiot " * 3 + "1d10t",
    "word " * 30000,
    "x" * 70000,
    "\x00\x85　  z",
]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, ["a"]).where("doc_id < 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def both(documents, odd):
    """The driver's documents and the odd ones, some twice, some without an id."""
    from pyspark.sql import functions as F

    base = ["doc_id", "text", "lang", "source", "n_chars"]
    more = odd.select(*base).withColumn("doc_id", F.col("doc_id") + 100_000)
    return documents.select(*base).union(more).union(more.where("doc_id > 100007").withColumn("doc_id", F.col("doc_id") + 50)).coalesce(3).persist()
