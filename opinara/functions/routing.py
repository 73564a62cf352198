"""What a question asks for: its system, intent, entities and kind, as columns over a table of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions import text as T

# Stems and phrases that decide, in the order in which they are tried.
CLINIC_STEMS = (
    "клиник", "медицинск", "медцентр", "услуг", "процедур", "врач", "доктор", "отзыв", "пациент", "репутац", "симптом", "приём", "прием у",
    "больниц", "поликлиник",
)
GOODS_STEMS = ("товар", "продукт", "айфон", "iphone", "телефон", "ноутбук", "наушник", "телеграм", "telegram", "канал", "пост")
ANALYZE = (
    "проанализируй", "разбери", "сделай разбор", "репутац", "что раздража", "что хвалят", "опиши репутацию", "что не нравится",
    "что нравится пациентам",
)
COMPARE = ("сравни ", "сравнить ", "сравнение ", " vs ", " против ", "что лучше", "лучше ли")
SEARCH = ("что говорят про", "что пишут про", "покажи отзывы", "найди отзывы", "отзывы про")
CONTINUED = (
    "а теперь", "теперь по", "то же", "тоже самое", "то же самое", "ту же", "тот же", "по той же", "по тому же", "и ещё", "ещё одна",
    "ещё одного", "ещё одну", "тогда", "и по",
)
ENTITY_STEMS = {
    "клиник": "clinic", "медицинск центр": "clinic", "медцентр": "clinic", "услуг": "service", "процедур": "service", "направлен": "category",
    "категор": "category", "врач": "doctor", "доктор": "doctor", "специалист": "doctor",
}
QUESTION_KINDS = {
    "comparison": ("сравни", "лучше", "хуже", "vs"),
    "pros_cons": ("плюс", "минус", "достоин", "недостат"),
    "sentiment": ("настроен", "эмоци", "sentiment", "тон"),
}
# Patterns of questions, quotes, keys and pairs.
ASKS = r"(?iU)\b(проанализируй|разбери|сделай разбор|сравни|сравнение|сравнить)\b"
QUOTED = "(?U)[«\"'']\\s*([^«»\"'']{2,120}?)\\s*[»\"'']"
AFTER_KEY = (
    r"(?iU)(?:по\s+(?:услуге|клинике|категории|направлению|врачу|доктору)|клиник[уи]|услуг[уе]|направлени[ея]|врач[ау]|доктор[ау])"
    r"\s+([^.;:,!?\n]{3,120})"
)
PAIR = r"(?iU)(?:сравни(?:ть)?|сравнение)\s+(.+?)\s+(?:и|с|vs|против)\s+(.+?)(?:[.?!,;]|$)"
ABOUT = r"(?iU)(?:про|о)\s+(.+?)(?:[.?!,;]|$)"
MARKS = " .,;:!?\"'«»"
# Phrases to search for by kind of entity, and by field.
DEFAULT_SEARCH = {
    "clinic": "жалобы пациентов, ожидание, отношение администраторов, цены, что хвалят и что раздражает",
    "service": "что раздражает пациентов в этой услуге, цена, подготовка, длительность, результат, чего не хватает на странице",
    "category": "повторяющиеся жалобы и похвала по направлению, типичные ожидания пациентов",
    "doctor": "квалификация, манера общения, объяснения, отношение к пациенту, отзывы пациентов",
}
FIELD_HINTS = {
    "top_complaints": "жалобы", "top_praises": "похвала", "target_audience": "целевая аудитория", "ad_angle": "ракурс для рекламы",
    "landing_page_gaps": "чего не хватает на странице", "service_improvements": "что улучшить в сервисе",
}
# Fields that doctors' cards and services answer.
DOCTOR_FIELDS, SERVICE_FIELDS = {"best_doctor", "doctor_signal"}, {"service_description", "landing_page_gaps"}


def _low(query: Column) -> Column:
    return F.lower(F.coalesce(query, F.lit("")))


def hits(query: Column, stems: tuple[str, ...]) -> Column:
    """How many of the stems a question has."""
    return reduce(lambda a, b: a + b, (F.contains(_low(query), F.lit(s)).cast("int") for s in stems), F.lit(0))


def _first(query: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The first name of the table one of whose stems the question has, else null."""
    return F.coalesce(*(F.when(hits(query, stems) > 0, name) for name, stems in table.items()))


def entity_kind(query: Column) -> Column:
    return F.coalesce(*(F.when(_low(query).contains(stem), kind) for stem, kind in ENTITY_STEMS.items()))


def question_kind(query: Column) -> Column:
    return F.coalesce(_first(query, QUESTION_KINDS), F.lit("product_lookup"))


def is_continued(query: Column) -> Column:
    return hits(query, CONTINUED) > 0


def quoted(query: Column) -> Column:
    """What stands in quotes, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(QUOTED), F.lit(1)), T.strip)
    return F.filter(found, lambda x: x != "")


def capitalised(query: Column, n: int = 3) -> Column:
    """The first n words of over three letters that begin with a capital."""
    bare = F.transform(F.split(F.coalesce(query, F.lit("")), r"(?U)\s+"), lambda w: F.btrim(w, F.lit(".,!?()[]{}\"'")))
    return F.slice(F.filter(bare, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{Lu}")), 1, n)


def _after(query: Column, pattern: str) -> Column:
    """What follows a key, as a list of one or none."""
    none = F.array().cast("array<string>")
    return F.when(query.rlike(pattern), F.array(F.btrim(F.regexp_extract(query, pattern, 1), F.lit(MARKS)))).otherwise(none)


def _or_else(some: Column, other: Column) -> Column:
    return F.when(F.size(some) > 0, some).otherwise(other)


def route(query: Column, own: tuple[str, ...] = ()) -> Column:
    """struct<system, confidence>: ``clinics`` or ``general``; own are the names that a site's users call it by."""
    clinics, goods, asks = hits(query, CLINIC_STEMS + own), hits(query, GOODS_STEMS), _low(query).rlike(ASKS)
    found = [
        ((clinics > 0) & (clinics >= goods), "clinics", F.when((clinics >= 2) | asks, 0.85).otherwise(0.7)),
        (goods > 0, "general", F.when(goods >= 2, 0.7).otherwise(0.55)),
        (asks, "clinics", F.lit(0.55)),
        (F.lit(True), "general", F.lit(0.4)),
    ]
    return F.coalesce(*(F.when(holds, F.struct(F.lit(system).alias("system"), sure.alias("confidence"))) for holds, system, sure in found))


def sticky(routed: Column, last: Column) -> Column:
    """A route of less than 0.7 stays with the session's last system, then of 0.65 at least."""
    stays = last.isin("clinics", "general") & (routed["confidence"] < 0.7)
    kept = F.struct(last.alias("system"), F.greatest(routed["confidence"], F.lit(0.65)).alias("confidence"))
    return F.when(stays, kept).otherwise(routed)


def intent(query: Column) -> Column:
    """struct<intent, entity_kind, entities, confidence>: comparisons first, then analyses, then searches, else fallback."""
    raw = T.strip(F.regexp_replace(T.strip(F.coalesce(query, F.lit(""))), r"(?iU)^(пожалуйста|пож-та|please)[,\s]+", ""))
    named, kind, pair = quoted(raw), entity_kind(raw), raw.rlike(PAIR)
    two = F.filter(F.array(*(F.btrim(F.regexp_extract(raw, PAIR, i), F.lit(MARKS)) for i in (1, 2))), lambda x: x != "")
    analysed = _or_else(named, _after(raw, AFTER_KEY))
    clinic = F.coalesce(kind, F.lit("clinic"))
    found = [
        (pair | (hits(raw, COMPARE) > 0), "reputation_compare", clinic, F.when(pair & (F.size(named) < 2), two).otherwise(named), F.when(F.size(named) >= 2, 0.9).when(pair, 0.7).otherwise(0.55)),
        (hits(raw, ANALYZE) > 0, "reputation_analyze", clinic, analysed, F.when(F.size(analysed) > 0, 0.75).otherwise(0.45)),
        (hits(raw, SEARCH) > 0, "rag_search", kind, _or_else(named, _after(raw, ABOUT)), F.lit(0.5)),
        (F.lit(True), "fallback", kind, named, F.lit(0.2)),
    ]
    made = lambda name, k, e, c: F.struct(F.lit(name).alias("intent"), k.alias("entity_kind"), e.alias("entities"), c.alias("confidence"))
    return F.coalesce(*(F.when(holds, made(*rest)) for holds, *rest in found))


def named_late(query: Column) -> Column:
    """What a question names in quotes, else after a key."""
    return _or_else(quoted(query), _after(query, AFTER_KEY))


def in_session(query: Column, asked: Column, last: Column) -> Column:
    """asked with what it lacks from last (struct<intent, entity_kind, entities>; null without a session)."""
    more, fallback, none = is_continued(query), asked["intent"] == "fallback", F.size(asked["entities"]) == 0
    has = F.coalesce(last["intent"], F.lit("")) != ""
    kind = F.coalesce(F.nullif(asked["entity_kind"], F.lit("")), F.nullif(last["entity_kind"], F.lit("")))
    entities = F.when(none & ~more & fallback & (F.size(last["entities"]) > 0), last["entities"]).otherwise(asked["entities"])
    named = more & (F.size(entities) > 0) & has  # a continuation that names entities of its own
    goes_on, search = fallback & more & has, (asked["intent"] == "rag_search") & named
    name = F.when(goes_on | search, last["intent"]).otherwise(asked["intent"])
    surer = search | (goes_on & named & last["intent"].isin("fallback", "rag_search"))
    sure = F.greatest(asked["confidence"], F.when(surer, 0.75).when(goes_on, 0.7).otherwise(0.0))
    late = F.when((name != "fallback") & (F.size(entities) == 0), named_late(query)).otherwise(entities)
    kept = F.struct(name.alias("intent"), kind.alias("entity_kind"), late.alias("entities"), sure.alias("confidence"))
    return F.when(last.isNull(), asked).otherwise(kept)


def search_text(kind: str, name: Column, fields: list[str], override: str | None = None) -> Column:
    """The words to search an entity's chunks for: its name, its kind's default phrase, hints of the fields asked for."""
    hints = "; ".join(hint for field, hint in FIELD_HINTS.items() if field in fields)
    return F.lit(override) if override else F.concat_ws(". ", F.nullif(name, F.lit("")), F.lit(DEFAULT_SEARCH.get(kind, DEFAULT_SEARCH["service"])), F.lit(hints or None))


def chunk_kinds(fields: list[str]) -> list[str]:
    """The kinds of chunks that answer some fields."""
    return ["review"] + ["doctor"] * bool(DOCTOR_FIELDS & set(fields)) + ["service"] * bool(SERVICE_FIELDS & set(fields))


def is_incomplete(loaded: Column, total: Column) -> Column:
    return F.coalesce(loaded < total, F.lit(False))
