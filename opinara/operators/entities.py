"""Entities: their keys, matching by name, groups of reviews, scopes."""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import text as T

FIELDS_OF_SCOPE = {
    "service": ("service_name", "parent_service_name"),
    "category": ("category_direction_title", "parent_service_name"),
    "doctor": ("doctor_name",),
    "clinic": ("clinic_name", "clinic_alias"),
    "city": ("clinic_city",),
}


def entity_key(kind: str) -> Column:
    """What a review counts for, by the kind of entity; ``unknown`` if it says nothing."""
    field = lambda name: T.or_null(F.col(name))
    if kind == "clinic":
        key = F.coalesce(field("clinic_alias"), field("clinic_name"))
    elif kind == "service":
        key = F.nullif(F.concat_ws("/", field("parent_service_name"), field("service_name")), F.lit(""))
    elif kind == "category":
        key = F.coalesce(field("parent_service_name"), field("category_direction_title"))
    elif kind == "doctor":
        key = F.coalesce(F.nullif(F.col("doctor_id").cast("string"), F.lit("0")), field("doctor_name"))
    else:
        raise ValueError(f"no such kind of entity: {kind}")
    return F.coalesce(key, F.lit("unknown"))


def parse_scope(given: dict[str, str]) -> dict[str, str]:
    """Keys with or without ``scope_``; unknown ones and blanks drop out."""
    bare = {k.removeprefix("scope_"): v for k, v in given.items()}
    return {k: v for k, v in bare.items() if k in FIELDS_OF_SCOPE and v and v.strip()}


def in_scope(reviews: DataFrame, scope: dict[str, str]) -> DataFrame:
    """Reviews whose fields mention each value of a scope."""
    for kind, value in parse_scope(scope).items():
        reviews = reviews.where(T.mentions(F.concat_ws(" ", *FIELDS_OF_SCOPE[kind]), value))
    return reviews


MOST_NEEDLES = 1000
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The different stretches of n characters."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def containing(names: DataFrame, needles: DataFrame) -> DataFrame:
    """Pairs (name, needle) of a name that contains a needle, of tables of different ones without empty ones, both of any size.

    An index has the stretches of GRAM characters of each name; a needle is looked up by that of its own stretches that the
    fewest names have, and what shares it is searched for the whole. A needle shorter than that is a stretch itself."""
    index = names.select("name", F.explode(F.concat(*(_grams(F.col("name"), n) for n in range(1, GRAM + 1)))).alias("gram"))
    own = needles.select("needle", F.explode(_grams(F.col("needle"), GRAM)).alias("gram"))
    common = index.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    found = own.join(common, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rarest = found.where("least.n > 0").select("needle", "least.gram")  # a stretch that no name has: nor has one the needle
    wanted = rarest.union(needles.where(F.length("needle") < GRAM).select("needle", F.col("needle").alias("gram")))
    return index.join(wanted, "gram").where(F.contains("name", F.col("needle"))).select("name", "needle")


def match_needles(entities: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, entity_id, entity_name, pos, score) of names that contain a needle. A query's few words are compared with each name;
    more than MOST_NEEDLES are looked up in an index."""
    name, needle = T.for_matching(F.col("entity_name")), T.for_matching(F.col("needle"))
    if needles.limit(MOST_NEEDLES + 1).count() > MOST_NEEDLES:
        own, wanted = entities.withColumn("_name", name), needles.withColumn("_needle", needle)
        different = lambda df, c, to: df.select(F.col(c).alias(to)).where(F.col(c) != "").distinct()
        pairs = containing(different(own, "_name", "name"), different(wanted, "_needle", "needle")).toDF("_name", "_needle")
        found = own.join(pairs, "_name").join(wanted, "_needle").drop("_name", "_needle")
    else:
        found = entities.join(F.broadcast(needles), name.contains(needle) & (needle != ""))  # MOST_NEEDLES rows
    whole = F.array_contains(F.split(name, " "), needle)
    return found.withColumn("score", F.length(needle) + F.when(name.startswith(needle) | whole, 10).otherwise(0))


def best_match(entities: DataFrame, needles: DataFrame) -> DataFrame:
    """For each needle the entity of the best score, the first in pos of equals."""
    best = F.min_by(F.struct("entity_id", "entity_name", "score"), F.struct(-F.col("score"), F.col("pos"))).alias("b")
    return match_needles(entities, needles).groupBy("needle").agg(best).select("needle", "b.*")


def group_reviews(reviews: DataFrame, kind: str, limit: int) -> DataFrame:
    """Entities by their distinct reviews, most first."""
    own = reviews.withColumn("entity_id", entity_key(kind)).select("entity_id", "review_id").distinct()
    return own.groupBy("entity_id").agg(F.count("*").alias("review_count")).orderBy(F.col("review_count").desc(), "entity_id").limit(limit)


def seeded_groups(catalogue: DataFrame, counts: DataFrame) -> DataFrame:
    """All entities of a catalogue (entity_id, entity_name), those without reviews with a count of zero."""
    return catalogue.join(counts, "entity_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


def likeness_bound(name: Column, wanted: str) -> Column:
    """What the ratio of matching blocks of name and wanted can be at most: by the characters that both have, in any order."""
    shared = (F.least(F.length(name) - F.length(F.replace(name, F.lit(c), F.lit(""))), F.lit(n)) for c, n in Counter(wanted).items())
    both = F.length(name) + len(wanted)
    return F.when(both == 0, 1.0).otherwise(reduce(lambda a, b: a + b, shared, F.lit(0)) * 2.0 / both)


def suggest(names: DataFrame, wanted: str, k: int = 5, least: float = 0.5) -> DataFrame:
    """(name, ratio): the first k names that contain the wanted one, else the k likest of a ratio of least or more, of equals the later
    by name first. Each name counts once; only those whose bound reaches least are compared block by block."""
    names = names.select("name").where("name is not null").distinct()
    hits = names.where(F.lower("name").contains(wanted.lower().strip())).select("name", F.lit(1.0).alias("ratio"))
    if not hits.isEmpty():
        return hits.orderBy("name").limit(k)
    near = names.where(likeness_bound(F.col("name"), wanted) >= least).select("name", T.likeness(wanted)("name").alias("ratio"))
    return near.where(F.col("ratio") >= least).orderBy(F.col("ratio").desc(), F.col("name").desc()).limit(k)


def risk_reviews(reviews: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Unanswered reviews first, then low ratings; none and 0 count as 10."""
    order = [F.col("answered").asc(), F.coalesce(F.nullif("rating", F.lit(0.0)), F.lit(10.0)).asc(), F.col("pos").asc()]
    if not by:
        return reviews.orderBy(*order).limit(k)
    return reviews.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def sample_within(reviews: DataFrame, by: list[str], text: str, budget: int, n: int) -> DataFrame:
    """Each entity's first n reviews as long as their texts together stay within budget characters. Tasks keep n rows of an entity
    each before any row moves (a limit of the window's groups), so that an entity's rows never meet but for those."""
    first = Window.partitionBy(*by).orderBy("pos")
    upto = F.sum(F.length(text)).over(first.rowsBetween(Window.unboundedPreceding, 0))
    return reviews.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n).withColumn("upto", upto).where(F.col("upto") <= budget)
