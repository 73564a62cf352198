"""The elements of one large JSON document, read by many tasks.

The text reader splits a file among tasks, and its records at each closing brace. Where a record begins inside a string is told by
the quotes before it, how deep by the brackets before it: prefix sums over blocks of the file. Records are then put together to
the elements of a list that the document has under a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.operators.prefix import before
from opinara.storage import durable

#: Records that are worked on together.
CHUNK = 1 << 15
_STRING = r'"(?:[^"\\]|\\.)*+"'
_TOKENS = rf'(?s){_STRING}|[\[\]{{}},:]|[^"\[\]{{}},:]++'
_STATE = "struct<depth:int,at:int,start:int,box:string,last:string,open:string,fields:array<struct<key:string,value:string>>>"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, text) of what stands before closing braces, the brace included: block and at are in the file's order."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.concat("value", F.lit("}")).alias("text"),
    )


def _whole_strings(records: DataFrame) -> DataFrame:
    """(file, chunk, seq, text): records joined where a brace stands in a string, so that each has one that closes, at its end."""
    quotes = F.regexp_count(F.regexp_replace("text", r"(?s)\\.", ""), F.lit('"'))
    placed = before(records.withColumn("quotes", quotes), ["file"], "block", ["at"], {"seen": F.col("quotes")})
    placed = placed.withColumn("starts", (F.col("seen") % 2 == 0).cast("int"))
    placed = durable(placed.select("file", "block", "at", "text", "starts"), "records")
    numbered = before(placed, ["file"], "block", ["at"], {"earlier": F.col("starts")})
    numbered = numbered.withColumn("seq", F.col("earlier") + F.col("starts") - 1).withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    parts = numbered.repartition("file", "chunk").groupBy("file", "chunk", "seq").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts"))
    return parts.select("file", "chunk", "seq", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def _walk(text: Column, depth: Column, box: str) -> Column:
    """The tokens of a record that begins at a depth, one after the other: where the last object of the third level starts, which box
    (key and bracket) of the second level is open or was closed, and the plain fields of the first."""

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        third = opens & (s["depth"] == 2)
        start = F.when(third, F.when(t == "{", s["at"])).when(closes & (depth == 2), F.when(t == "}", s["start"])).otherwise(s["start"])
        opened = F.when(opens & (s["depth"] == 1), F.concat(F.coalesce(s["open"], F.lit("")), t)).when(closes & (depth <= 1), F.lit("")).otherwise(s["box"])
        top, plain = s["depth"] == 1, F.trim(t) != ""
        value = top & s["open"].isNotNull() & plain & ~opens & ~closes & ~t.isin(",", ":")
        last = F.when(top & t.startswith('"'), t).otherwise(s["last"])
        key = F.when(top & (t == ":"), s["last"]).when(top & (t.isin(",") | opens | value), F.lit(None)).otherwise(s["open"])
        fields = F.when(value, F.concat(s["fields"], F.array(F.struct(s["open"].alias("key"), F.trim(t).alias("value"))))).otherwise(s["fields"])
        return F.struct(
            depth.alias("depth"), (s["at"] + F.length(t)).alias("at"), start.alias("start"), opened.alias("box"), last.alias("last"), key.alias("open"), fields.alias("fields")
        ).cast(_STATE)

    nothing = F.struct(depth.cast("int"), F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.array())
    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), nothing.cast(_STATE), step)


def elements(spark: SparkSession, path: str, field: str) -> tuple[DataFrame, DataFrame]:
    """The objects in the list that each document under path has as field, and the documents' plain fields:
    (file, number, element), numbers rising in the file's order, and (file, key, value), both as JSON text.

    Each file is one document, an object. Objects in lists or objects of the list are part of their elements; what isn't an object is
    left out, and so is an element that a cut-off file doesn't end. Tasks read parts of a file of any size; none holds more than
    a part, a string or an element. A file that isn't JSON gives what looks like elements, or nothing.
    """
    bare = F.regexp_replace("text", f"(?s){_STRING}", '""')
    whole = _whole_strings(_records(spark, path)).withColumn("bare", bare)
    brackets = {"opens": F.regexp_count("bare", F.lit(r"[\[{]")), "lists_end": F.regexp_count("bare", F.lit(r"\]")), "next": F.col("bare").rlike(r"^\s*,?\s*\{")}
    whole = durable(whole.withColumns(brackets).drop("bare"), "strings")
    change = F.col("opens") - F.col("lists_end") - 1
    deep = before(whole, ["file"], "chunk", ["seq"], {"depth": change})
    plain = (F.col("depth") == 2) & F.col("next")
    walked = F.when(~plain & (F.col("depth") - F.col("lists_end") <= 2), _walk(F.col("text"), F.col("depth"), field))
    deep = deep.withColumn("walked", walked).select(
        "file", "chunk", "seq", "text", (F.col("depth") + change).alias("after"),
        F.when(plain, F.instr("text", "{") - 1).otherwise(F.col("walked.start")).alias("start"), F.col("walked.box").alias("box"), F.col("walked.fields").alias("fields"),
    )
    deep = durable(deep, "depths")
    placed = before(deep, ["file"], "chunk", ["seq"], {"number": (F.col("after") <= 2).cast("int")}, {"in_box": F.col("box")})
    here = F.coalesce("box", "in_box") == f'"{field}"['
    parts = placed.groupBy("file", "number", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "text"))).alias("parts"), F.max((F.col("after") == 2) & here).alias("ends")
    )
    parts = parts.groupBy("file", "number").agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"), F.max("ends").alias("ends"))
    first = F.array_max(F.transform(F.filter("parts", lambda p: p["start"].isNotNull()), lambda p: p["seq"]))
    kept = parts.where("ends").withColumn("first", first).where("first is not null")
    cut = lambda p: F.when(p["seq"] == F.col("first"), F.substring(p["text"], p["start"] + 1, F.length(p["text"]))).otherwise(p["text"])
    texts = F.transform(F.filter("parts", lambda p: p["seq"] >= F.col("first")), cut)
    return kept.select("file", "number", F.array_join(texts, "").alias("element")), deep.select("file", F.inline("fields"))
