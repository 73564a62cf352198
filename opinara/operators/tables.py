"""Filters, joins, set operations, deduplication and upserts on tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.storage import durable


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Rows with each given value; None asks for nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in values.items() if v is not None), df)


def where_in(df: DataFrame, column: str, values: list | None) -> DataFrame:
    return df.where(F.col(column).isin(*values)) if values else df


def where_between(df: DataFrame, column: str, low: datetime | None = None, high: datetime | None = None) -> DataFrame:
    """Both ends included; None leaves an end open."""
    df = df if low is None else df.where(F.col(column) >= F.lit(low))
    return df if high is None else df.where(F.col(column) <= F.lit(high))


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value)).limit(1)


def first_nonempty(*candidates: DataFrame) -> DataFrame:
    """The first candidate with a row, else the last; each is asked for one row only."""
    return next((df for df in candidates[:-1] if not df.isEmpty()), candidates[-1])


def where_true(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all columns are true; null counts as false."""
    return reduce(lambda d, c: d.where(F.col(c)), columns, df)


def where_false(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which no column is true or null."""
    return reduce(lambda d, c: d.where(~F.col(c)), columns, df)


def where_present(df: DataFrame, *columns: str) -> DataFrame:
    return reduce(lambda d, c: d.where(F.col(c).isNotNull()), columns, df)


EARLY = 10_000  # rows up to which a page is cut from the first ones of each task


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """A page of a total order; numbers beyond the ends give the first or last page.

    An early page is cut from the first EARLY rows. For a late one rows are ranked where they lie: partitions of a sort are
    numbered by their sizes, so that it brings its own rows together and no others."""
    if number * size <= EARLY:
        total = df.count()
        low = (min(max(1, number), max(1, -(-total // size))) - 1) * size
        return df.orderBy(*order).offset(low).limit(size)
    ranked = durable(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "page")
    parts = ranked.groupBy("_part").agg(F.count("*").alias("_rows"))  # a row for each partition
    ahead = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.select("_part", ahead.alias("_ahead"), "_rows").collect()
    total = sum(r["_rows"] for r in sizes)
    low = (min(max(1, number), max(1, -(-total // size))) - 1) * size
    hit = [r for r in sizes if r["_ahead"] < low + size and r["_ahead"] + r["_rows"] > low]
    at = reduce(lambda rest, r: F.when(F.col("_part") == r["_part"], F.col("_nth") + r["_ahead"]).otherwise(rest), hit, F.lit(-1).cast("long"))
    rows = ranked.where(F.col("_part").isin(*(r["_part"] for r in hit))) if hit else ranked.where("false")
    rows = rows.withColumn("_at", at).where(F.col("_at").between(low, low + size - 1))
    return rows.orderBy("_at").drop("_part", "_nth", "_at")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def merge_keep_last(df: DataFrame, key: Column, position: str) -> DataFrame:
    """Of each key the last row, at the position of its first one. One aggregate, so that a key's rows meet only as their
    tasks' last and first ones."""
    last = F.max_by(F.struct(*df.columns), position).alias("_last")
    merged = df.groupBy(key.alias("_key")).agg(last, F.min(position).alias("_at")).select("_last.*", "_at")
    return merged.withColumn(position, F.col("_at")).drop("_at")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], position: str) -> DataFrame:
    """old with the rows of new, by keys; of several new rows the last. The stored table is then replaced as a whole."""
    both = old.withColumn("_new", F.lit(0)).withColumn(position, F.lit(None).cast("long")).unionByName(new.withColumn("_new", F.lit(1)).withColumn(position, F.col(position).cast("long")))
    return keep_first(both, keys, [F.col("_new").desc(), F.col(position).desc_nulls_last()]).drop("_new", position)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose keys old doesn't have."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def existing(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def drop_unknown(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose column is blank or known; all of them where nothing is known."""
    marked = df.join(known.select(F.col(column).alias("_known")).distinct(), F.col(column) == F.col("_known"), "left")
    some = known.select(F.count("*").alias("_n"))  # one row
    return marked.join(F.broadcast(some)).where((F.coalesce(column, F.lit("")) == "") | F.col("_known").isNotNull() | (F.col("_n") == 0)).drop("_known", "_n")


def reviews_deduped(reviews: DataFrame) -> DataFrame:
    """Of reviews (review_id, text, clinic_alias, created, patient_public_name, src_order, pos, ...) the first of each id.

    Ids that aren't positive numbers drop out; null ids get a synthetic one if there is text, else drop out too.
    """
    made = T.synthetic_id(F.col("clinic_alias"), F.col("created"), F.col("text"), F.col("patient_public_name"))
    own = F.when(F.col("review_id").isNull(), F.when(T.filled(F.col("text")), made)).otherwise(T.positive_id(F.col("review_id")))
    return keep_first(reviews.withColumn("review_id", own).where("review_id is not null"), ["review_id"], [F.col("src_order"), F.col("pos")])


def ingest_counts(rows: DataFrame, reason: Column) -> DataFrame:
    """Inserted rows, and skipped ones by reason."""
    return rows.groupBy(F.coalesce(reason, F.lit("inserted")).alias("reason")).agg(F.count("*").alias("n"))


def in_city(reviews: DataFrame, clinics: DataFrame, city: str) -> DataFrame:
    """Reviews of a city: by their clinic's address if it is known, else by their own, else kept."""
    at = clinics.groupBy("clinic_alias").agg(F.max(F.lower("city") == city.lower()).alias("_in"))
    return reviews.join(at, "clinic_alias", "left").where(F.coalesce("_in", F.lower("clinic_city") == city.lower(), F.lit(True))).drop("_in")


def reuse_embeddings(chunks: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """chunks with the embeddings that stored has; the others stay null for the embedder."""
    return chunks.join(stored.select(*keys, "embedding"), keys, "left")
