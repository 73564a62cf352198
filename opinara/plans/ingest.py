"""Ingestion as one plan each: crawls, reviews, chats and the index of chunks, with a reason for each row that stays out.

Models are injected: ``analyse`` and ``embed`` take and return a DataFrame; without them the rules alone decide. All
functions are lazy; what goes into a stored table is what they return, to be appended or written over the table as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import tables as S
from opinara.sources import readers

Model = Callable[[DataFrame], DataFrame]


def ingest_crawl(doc: DataFrame, skip_empty: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Services, clinics, doctors, profiles and reviews of a crawl, each with reason (null: goes in), and their counts.

    doc: readers.crawl. With skip_empty, entities without reviews, clinics that no service page names and reviews of
    unknown clinics stay out. Reviews of another city than the crawl's always do. Of equal ids the first counts.
    """
    pages = doc.select(F.posexplode("services").alias("pos", "s")).where("s.ok")
    total = lambda c: F.coalesce(c.try_cast("int"), F.lit(0)) > 0
    empty = lambda has: F.when(F.lit(skip_empty) & ~F.coalesce(has, F.lit(False)), "skipped_empty")
    named = pages.select(F.explode("s.clinics").alias("c")).select("c.clinic_alias").where("clinic_alias <> ''").distinct().withColumn("named", F.lit(True))
    services = S.keep_first(pages.select("pos", "s.page_url", "s.service.*", F.try_element_at("s.breadcrumbs", F.lit(1))["name"].alias("direction"), empty((F.size("s.reviews") > 0) | total(F.col("s.reviews_count_total"))).alias("reason")).where("id > 0"), ["id"], [F.col("pos")])
    doctors = pages.select("pos", F.posexplode("s.doctors").alias("at", "d")).select("pos", "at", "d.*").where("doctor_id > 0")
    doctors = S.keep_first(doctors.withColumn("reason", empty(total(F.col("reviews_count")))), ["doctor_id"], [F.col("pos"), F.col("at")])
    clinics = doc.select(F.explode("clinics").alias("c")).where("c.ok").select("c.page_url", "c.clinic_alias", "c.clinic.*")
    clinics = clinics.join(named, "clinic_alias", "left").withColumn("reason", empty(F.col("named"))).drop("named")
    profiles = doc.select(F.explode("doctor_profiles").alias("p")).where("p.ok").select("p.page_url", "p.doctor_alias", "p.doctor.*", empty((F.size("p.reviews") > 0) | total(F.col("p.doctor.reviews_count"))).alias("reason"))
    known = doc.select(F.lower(T.or_null(F.col("target_city_name"))).alias("city")).limit(1).crossJoin(named.agg(F.count("*").alias("aliases")))  # one row
    rows = S.reviews_deduped(readers.crawl_reviews(doc)).join(named, "clinic_alias", "left").crossJoin(F.broadcast(known))
    away = T.filled(F.col("clinic_city")) & (F.lower(T.strip(F.col("clinic_city"))) != F.col("city"))
    unknown = F.lit(skip_empty) & (F.col("aliases") > 0) & (F.coalesce("clinic_alias", F.lit("")) != "") & F.col("named").isNull()
    reason = F.when(F.coalesce(away, F.lit(False)), "skipped_other_city").when(unknown, "skipped_unknown_clinic").when(~T.filled(F.col("text")), "skipped")
    out = {"services": services, "doctors": doctors, "clinics": clinics, "profiles": profiles, "reviews": rows.withColumn("reason", reason).drop("named", "city", "aliases")}
    counts = None
    for name, df in out.items():
        part = S.ingest_counts(df, F.col("reason")).select(F.lit(name).alias("entity"), "reason", "n")
        counts = part if counts is None else counts.unionByName(part)
    return out, counts


def reingest(spark: SparkSession, path: str, skip_empty: bool = True, lines: bool = False) -> tuple[dict[str, DataFrame], DataFrame] | None:
    """ingest_crawl of what a crawl that didn't end has saved so far; None where it has saved nothing that can be read."""
    doc = readers.crawl_checkpoint(spark, path, lines)
    return None if doc is None else ingest_crawl(doc, skip_empty)


def crawl_stats(doc: DataFrame) -> DataFrame:
    """One row: what a crawl has fetched by phase, and its distinct reviews."""
    size = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0))
    fetched = doc.agg(
        size("services").alias("services_fetched"),
        size("clinics").alias("clinics_fetched"),
        size("doctor_profiles").alias("doctor_profiles_fetched"),
        F.coalesce(F.sum(F.aggregate("services", F.lit(0), lambda n, s: n + F.greatest(F.size(s["doctors"]), F.lit(0)))), F.lit(0)).alias("doctors_on_services"),
    )
    return fetched.crossJoin(S.reviews_deduped(readers.crawl_reviews(doc)).agg(F.count("*").alias("reviews_collected")))  # one row each


def upsert_chunks(stored: DataFrame, new: DataFrame, position: str) -> DataFrame:
    """Stored chunks with new ones over those of their kind and ref; an embedding that the new chunk lacks becomes null."""
    return S.upsert(stored, new, ["kind", "ref"], position)


def crawl_chunks(doc: DataFrame, kinds: tuple[str, ...] = ("service", "doctor", "review")) -> DataFrame:
    """Chunks of a crawl's services, doctors and reviews, the first of each id."""
    found, _ = ingest_crawl(doc, skip_empty=False)
    makers = {"service": ("services", readers.service_chunks), "doctor": ("doctors", readers.doctor_chunks), "review": ("reviews", readers.review_chunks)}
    chunks = None
    for kind in kinds:
        name, make = makers[kind]
        part = make(found[name].drop("reason"))
        chunks = part if chunks is None else chunks.unionByName(part)
    return chunks


def build_index(chunks: DataFrame, stored: DataFrame, embed: Model | None = None, keys: tuple[str, ...] = ("kind", "ref"), most: int | None = None) -> DataFrame:
    """chunks with embeddings: those that stored has, else what embed makes of the rest (without it, null).

    most is the caller's own limit of chunks, by their keys; none by default. Embedded rows are not read twice by embed.
    """
    some = chunks.orderBy(*keys).limit(most) if most else chunks
    both = S.reuse_embeddings(some, stored, list(keys))
    if embed is None:
        return both
    return both.where("embedding is not null").unionByName(embed(both.where("embedding is null").drop("embedding")))


def ingest_reviews(new: DataFrame, stored: DataFrame, analyse: Model | None = None) -> DataFrame:
    """The rows of new (source_id, external_id, text, ...) to append: texts that say something, keys that stored lacks, once each.

    analyse adds rating, sentiment, summary and tags; without it a rating of 4, the first 200 characters and blanks.
    """
    fresh = S.insert_absent(stored, S.keep_first(new.where(T.is_review_text(F.col("text"))), ["source_id", "external_id"], [F.col("text")]), ["source_id", "external_id"])
    if analyse is not None:
        return analyse(fresh)
    return fresh.withColumns({"ai_rating": F.lit(4), "sentiment": F.lit(""), "summary": F.substring("text", 1, 200), "tags": F.lit("")})


def analysed(raw: DataFrame, answer: str) -> DataFrame:
    """The columns of an analysis from a model's text: ratings within 1 and 5 (4 if none), 500 characters of summary, tags joined."""
    kind = "struct<rating: string, sentiment: string, summary: string, tags: array<string>>"
    v = F.coalesce(F.from_json(T.lenient_object(F.col(answer)), kind), T.salvaged(F.col(answer)).cast(kind))
    v = {name: v[name] for name in ("rating", "sentiment", "summary", "tags")}
    rating = F.coalesce(v["rating"].try_cast("double").cast("int"), F.lit(4))
    summary = F.coalesce(F.substring(v["summary"], 1, 500), F.when(v["rating"].isNull() & v["summary"].isNull(), F.substring(F.col(answer), 1, 200)), F.lit(""))
    return raw.withColumns({"ai_rating": F.greatest(F.lit(1), F.least(F.lit(5), rating)), "sentiment": F.coalesce(v["sentiment"], F.lit("")), "summary": summary, "tags": F.coalesce(T.tags(v["tags"]), F.lit(""))})


def ingest_chat(messages: DataFrame, stored: DataFrame, analyse: Model | None = None, embed: Model | None = None) -> DataFrame:
    """The messages (export_key, message_id, text, reply_to, ...) to append: those with text that stored lacks.

    Plain advertisements get blanks and no embedding; the rest goes to analyse (topics, summary, market_research_interest,
    spam_or_ad, spam_reason) and, if it isn't spam, to embed by ``embed_text``.
    """
    keys = ["export_key", "message_id"]
    fresh = S.insert_absent(stored, S.keep_first(messages.where(T.filled(F.col("text"))), keys, [F.col("text")]), keys)
    body = F.when(F.col("reply_to").isNotNull(), F.concat(F.lit("[ответ на #"), F.col("reply_to").cast("string"), F.lit("] "), F.col("text"))).otherwise(F.col("text"))
    judged = fresh.withColumn("body", body).withColumn("p", T.promotion(F.col("text")))
    blank = {"market_research_interest": F.lit(False), "topics": F.lit(""), "summary": F.lit("")}
    spam = judged.where("p.spam").select("*", F.lit(True).alias("spam_or_ad"), F.col("p.reason").alias("spam_reason")).drop("p").withColumns({**blank, "analysis_source": F.lit("heuristic")})
    rest = judged.where("not p.spam").drop("p")
    blanks = {"spam_or_ad": F.lit(False), "spam_reason": F.lit(""), **blank}
    rest = (analyse(rest) if analyse else rest.withColumns(blanks)).withColumn("analysis_source", F.lit("model" if analyse else "none"))
    rows = spam.unionByName(rest)
    rows = rows.withColumn("embed_text", F.when(~F.col("spam_or_ad"), F.substring(T.strip(F.concat("summary", F.lit(". "), "topics", F.lit(". "), "body")), 1, 6000)))
    return embed(rows) if embed else rows
