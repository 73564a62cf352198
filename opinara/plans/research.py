"""What a research table asks for, how an entity's chunks are found, the views that callers see, and the chat's dispatch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.functions import routing
from opinara.functions import text as T
from opinara.operators import tables as S
from opinara.plans.tools import Tools
from opinara.sources import readers

# Fields of a research table with their labels, and the presets.
METRICS = {
    "reviews_count": "Число отзывов", "avg_rating": "Средняя оценка", "negative_share_pct": "Доля негативных, %",
    "unanswered_share_pct": "Без ответа клиники, %", "doctors_mentioned": "Врачей в отзывах", "latest_review": "Последний отзыв",
}
TEXTS = {
    "top_praises": "Что хвалят", "top_complaints": "Частые жалобы", "target_audience": "Целевая аудитория (сигнал)",
    "service_improvements": "Что улучшить в сервисе", "landing_page_gaps": "Чего не хватает на странице", "ad_angle": "Угол для рекламы",
    "executive_summary": "Сводка для руководителя",
}
PRESETS = {
    "clinic_competitors": [
        "reviews_count", "avg_rating", "negative_share_pct", "unanswered_share_pct", "top_praises", "top_complaints", "target_audience", "ad_angle",
    ],
    "service_competitors": ["reviews_count", "avg_rating", "negative_share_pct", "top_praises", "top_complaints", "landing_page_gaps", "ad_angle"],
    "category_landscape": ["reviews_count", "avg_rating", "top_complaints", "target_audience", "service_improvements", "executive_summary"],
}


class Field(NamedTuple):
    key: str
    kind: str
    label: str


def fields_of(keys: list[str] | None = None, preset: str | None = None) -> list[Field]:
    """The keys asked for, else the preset's, else the clinics'; unknown keys are texts of their own name."""
    chosen = keys or PRESETS.get(preset or "", PRESETS["clinic_competitors"])
    return [Field(k, "metric" if k in METRICS else "text", METRICS.get(k) or TEXTS.get(k) or k) for k in chosen]


def entity_filter(kind: str) -> Column:
    """map<column, value> that finds the chunks of a review's entity; ``_like`` columns by ILIKE. Empty if it says nothing."""
    named = lambda **given: F.map_filter(F.create_map(*(x for k, v in given.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    alias, did = T.or_null(F.col("clinic_alias")), T.positive_id(F.col("doctor_id"))
    parent = T.or_null(F.col("parent_service_name"))
    kinds = {
        "clinic": lambda: named(clinic_alias=alias, clinic_name_like=F.when(alias.isNull(), T.or_null(F.col("clinic_name")))),
        "service": lambda: named(service_name=T.or_null(F.col("service_name")), parent_service_name=parent),
        "category": lambda: named(parent_service_name=F.coalesce(parent, T.or_null(F.col("category_direction_title")))),
        "doctor": lambda: named(doctor_external_id=did, doctor_name_like=F.when(did.isNull(), T.or_null(F.col("doctor_name")))),
    }
    return kinds[kind]()


def filtered_chunks(chunks: DataFrame, found: dict[str, str], kinds: list[str] | None = None) -> DataFrame:
    """Chunks of some kinds that an entity_filter's map finds."""
    some = S.where_in(chunks, "kind", kinds)
    for name, value in found.items():
        some = some.where(F.col(name.removesuffix("_like")).ilike(f"%{value}%") if name.endswith("_like") else F.col(name) == F.lit(value))
    return some


def search_view(scored: DataFrame) -> DataFrame:
    """Search results as callers see them: a snippet of 400 characters in place of the body, no embedding."""
    hidden = {"body", "embedding", "pos", "vector_rank", "keyword_rank"}
    return scored.select(*(c for c in scored.columns if c not in hidden), F.substring(F.coalesce("body", F.lit("")), 1, 400).alias("snippet"))


def risk_view(risky: DataFrame) -> DataFrame:
    """Risky reviews as callers see them; texts have 500 characters."""
    c = readers.columns_of(risky)
    return risky.select(
        "review_id", "rating", "answered", F.substring(F.coalesce(c("text"), F.lit("")), 1, 500).alias("text"), c("doctor_name").alias("doctor_name"), c("clinic_name").alias("clinic_name"),
        c("service_name").alias("service_name"), c("source_page_url").alias("source_page_url"),
    )


def api_reviews(raw: DataFrame, body: str, position: str, size: int, clinics: DataFrame | None = None, city: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of a review API's rows in canonical columns, and a row (dropped): how many of it are of another city.

    size is the page's: rows beyond it belong to the next request.
    """
    first = readers.canonical_api_review(raw.orderBy(position).limit(size), body)
    kept = S.in_city(first, clinics, city) if city and clinics is not None else first
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return kept, count(first, "a").crossJoin(count(kept, "b")).select((F.col("a") - F.col("b")).alias("dropped"))  # one row each


def chat(spark: SparkSession, query: str, tools: Tools, last: tuple[str, str | None, list[str]] | None = None, override: str | None = None, detect: Callable[[Column], Column] = routing.intent) -> dict[str, Any]:
    """Answers a question by the tool of its intent (entity_kind, entities and query are passed on).

    Intents: reputation_compare (two entities or more), reputation_analyze (one), rag_search and fallback. Where entities lack,
    error is need_entities and nothing runs. last is the session's previous (intent, entity_kind, entities); detect gives the
    intent, as routing.intent does.
    """
    q = F.col("q")
    df = spark.createDataFrame([(query, last)], "q string, last struct<intent: string, entity_kind: string, entities: array<string>>")
    asked = df.select(routing.in_session(q, detect(q), F.col("last")).alias("v")).first()["v"].asDict()
    asked["intent"] = override if override in ("reputation_analyze", "reputation_compare", "rag_search", "fallback") else asked["intent"]
    entities, kind = asked["entities"] or [], asked["entity_kind"] or "clinic"
    if len(entities) < {"reputation_compare": 2, "reputation_analyze": 1}.get(asked["intent"], 0):
        return {"ok": False, "intent": asked, "error": "need_entities", "result": None}
    name = "rag_search" if asked["intent"] == "fallback" else asked["intent"]
    return {"ok": True, "intent": asked, "error": None, "result": tools.run(name, query=query, entity_kind=kind, entities=entities)}
