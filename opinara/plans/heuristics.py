"""Reports and comparisons without a language model: themes, shares and hints of many entities at once, a row for each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import entities as E
from opinara.operators import metrics as M

# What to improve and what to write on a page, by complaint.
IMPROVEMENTS = {
    "долгое ожидание и очереди": "Сократить ожидание: слоты, регистратура, информирование о задержках",
    "высокая цена": "Пересмотреть прайс или явно объяснять стоимость до приёма",
    "грубость и плохое отношение": "Стандарты коммуникации персонала и контроль тона на приёме",
    "ошибки диагностики и лечения": "Разбор клинических кейсов и контроль качества",
    "проблемы с записью и администрацией": "Упростить запись и работу регистратуры",
    "скрытые доплаты и прозрачность цены": "Прозрачный прайс и предупреждение о доплатах заранее",
}
LANDING = {
    "долгое ожидание и очереди": "Указать среднее время ожидания и как записаться без очереди",
    "высокая цена": "Добавить цену или вилку цен и что входит в услугу",
    "проблемы с записью и администрацией": "Описать способы записи и политику отмены",
    "скрытые доплаты и прозрачность цены": "Расписать состав услуги и возможные доплаты",
}
ALWAYS_ON_PAGE = ["Указать длительность приёма и что входит в услугу", "Добавить цену или вилку цен и способ записи"]
ANSWER_MORE = "Отвечать на негативные отзывы — высокая доля без ответа"
SET_STANDARDS = "Разобрать повторяющиеся жалобы и зафиксировать стандарты сервиса"
NO_PRAISE, NO_COMPLAINTS, NO_ADVICE, NO_RISKS = (
    "Мало явно положительных отзывов в выборке", "Явных негативных формулировок мало", "Нужно больше отзывов для точных рекомендаций",
    "Риск-темы не выделены",
)
FEW_COMPLAINTS, NOTHING_SHARED = "Явных жалоб мало", "Общих повторяющихся жалоб не выделено"
MADE_BY_RULE = "Текст сформирован автоматически из отзывов (LLM недоступен или не вернул JSON)."
# The parts of a report, those that are one text, and other names that models give them.
PARTS = {
    "executive_summary": ["executive_summary", "summary", "сводка", "резюме"],
    "what_patients_value": ["what_patients_value", "what_patients_like", "strengths", "positives", "плюсы", "что_ценят"],
    "top_complaints": ["top_complaints", "complaints", "weaknesses", "negatives", "жалобы"],
    "service_improvements": ["service_improvements", "improvements", "fixes", "что_починить"],
    "landing_page_gaps": ["landing_page_gaps", "landing_gaps", "page_gaps", "на_страницу"],
    "ad_angle": ["ad_angle", "advertising_angle", "реклама", "ad"],
    "target_audience": ["target_audience", "audience", "целевая_аудитория", "ца"],
    "risk_topics": ["risk_topics", "risks", "risk", "риски"],
}
ONE_TEXT = {"executive_summary", "ad_angle", "target_audience"}
NESTED = ["report", "result", "data", "analysis", "ответ"]
# What an answer says of failures, and of what is like a name that isn't there.
NOT_READ, NOT_COMPARED, LIKE_IT = "Не получилось разобрать объект: ", "Не получилось сравнить: ", "Похожие в данных: "
NO_SEARCH, ASK_OTHERWISE = "Поиск временно недоступен", "Постройте индекс, либо переформулируйте запрос."
HELP = (
    "Я умею разбирать отзывы. Попробуйте:\n- «Проанализируй отзывы по клинике \"Союз\"»\n- «Сравни клиники \"Союз\" и \"Авиценна\" по услуге \"Тонзиллор\"»\n"
    "- «Что говорят про детского ЛОРа?»"
)
WINNERS = {"avg_rating": "рейтинг", "answered_pct": "ответы на отзывы", "review_count": "число отзывов"}


def _listed(counts: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
    """The k most frequent themes of each entity, as a list."""
    top = M.top_per_group(counts, by, [F.col("n").desc(), F.col("theme")], k)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "theme"))), lambda x: x["theme"]).alias(name))  # of k rows


def _themes(reviews: DataFrame, by: list[str], text: str, themes: dict, complaints: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts of praise in good reviews, and of complaints in bad ones."""
    rating = F.coalesce(F.nullif("rating", F.lit(0.0)), F.lit(10.0))
    bad = {k: v for k, v in themes.items() if k in complaints}
    good = {k: v for k, v in themes.items() if k not in complaints}
    return M.theme_counts(reviews.where(F.col("rating") >= M.HIGH), text, good, by), M.theme_counts(reviews.where(rating < M.LOW), text, bad, by)


def _number(value: Column, places: int) -> Column:
    return T.round_exact(value, places).cast("string")


def _hints(table: dict[str, str], themes: Column, otherwise) -> Column:
    """What table says of each theme, else otherwise of it (null: left out)."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_compact(F.transform(themes, lambda t: F.coalesce(F.try_element_at(known, t), otherwise(t))))


def normalised(made: object) -> dict[str, Any]:
    """A model's report as the eight PARTS whatever it calls them or wraps them in: texts stripped, lists without blanks, and a
    text where a list should be as its lines."""
    plain = lambda d: {str(k).lower().replace(" ", "_"): v for k, v in d.items()}
    names = {alias for aliases in PARTS.values() for alias in aliases}
    own = plain(made) if isinstance(made, dict) else {}
    inner = (plain(own[k]) for k in NESTED if isinstance(own.get(k), dict))
    own = next((d for d in inner if names & d.keys()), own)
    out: dict[str, Any] = {}
    for part, aliases in PARTS.items():
        value = next((own[a] for a in aliases if own.get(a) is not None), None)
        if part in ONE_TEXT:
            out[part] = str(value or "").strip()
        elif isinstance(value, str):
            out[part] = [bare for line in value.split("\n") if line.strip() and (bare := line.strip(" -•"))]
        else:
            out[part] = [str(x).strip() for x in value if str(x).strip()] if isinstance(value, list) else []
    return out


def _quoted(names: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(names, 1, most), lambda n: F.concat(F.lit("«"), n, F.lit("»"))), ", ")


def _failed(head: str, error: Column, hint: Column) -> Column:
    said = F.concat(F.lit(head), F.coalesce(T.or_null(error), F.lit("unknown")), F.lit("."))
    return F.concat_ws(" ", said, T.or_null(hint))


def failed_report_answer(error: Column, hint: Column, suggestions: Column) -> Column:
    """A report that failed as a chat's answer: error (null: unknown), hint, and the first five of the names that are like the one asked
    for."""
    like = F.when(F.size(suggestions) > 0, F.concat(F.lit(LIKE_IT), _quoted(suggestions, 5)))
    return F.concat_ws("\n\n", _failed(NOT_READ, error, hint), like)


def failed_comparison_answer(error: Column, hint: Column, suggestions: Column) -> Column:
    """A comparison that failed as a chat's answer: of suggestions (array of name and candidates) the first three, three candidates each;
    names without candidates say nothing."""
    each = F.transform(F.filter(F.slice(suggestions, 1, 3), lambda s: F.size(s["candidates"]) > 0), lambda s: F.concat(F.lit("«"), s["name"], F.lit("» → "), _quoted(s["candidates"], 3)))
    like = F.when(F.size(each) > 0, F.concat(F.lit(LIKE_IT), F.array_join(each, "; ")))
    return F.concat_ws("\n\n", _failed(NOT_COMPARED, error, hint), like)


def search_answers(query: Column, ok: Column, error: Column, items: Column) -> Column:
    """A search as a chat's answer: why it failed; that it found nothing, and what can be asked; or how many chunks it found, with
    the title (else the id) and the first 240 characters of five. items: array of (title, chunk_id, snippet)."""
    failed = F.concat(F.concat_ws(": ", F.lit(NO_SEARCH), T.or_null(error)), F.lit(". " + ASK_OTHERWISE))
    nothing = F.concat(F.lit("По запросу «"), query, F.lit("» ничего не нашлось.\n\n" + HELP))
    text = lambda i: T.strip(F.translate(F.coalesce(i["snippet"], F.lit("")), "\n", " "))
    short = lambda t: F.when(F.length(t) > 240, F.concat(F.substring(t, 1, 240), F.lit("…"))).otherwise(t)
    line = lambda i: F.concat(F.lit("- **"), F.coalesce(T.or_null(i["title"]), i["chunk_id"].cast("string"), F.lit("")), F.lit("** — "), short(text(i)))
    found = F.concat(F.lit("Нашёл "), F.size(items).cast("string"), F.lit(" релевантных фрагментов:\n"), F.array_join(F.transform(F.slice(items, 1, 5), line), "\n"))
    return F.when(~F.coalesce(ok, F.lit(False)), failed).when(F.coalesce(F.size(items), F.lit(0)) <= 0, nothing).otherwise(found)


def report_answer(name: str, metrics: dict[str, Any], report: dict[str, Any]) -> str:
    """A report as a chat's answer: paragraphs for what it has."""
    head = f"**{name}** — отзывов: {metrics.get('review_count', 0)}, avg: {metrics.get('avg_rating')}, негатив: {metrics.get('negative_pct')}%, без ответа: {metrics.get('unanswered_pct')}%"
    titled = [("Что ценят", "what_patients_value"), ("Жалобы", "top_complaints"), ("На страницу добавить", "landing_page_gaps"), ("Угол для рекламы", "ad_angle")]
    said = lambda v: v if isinstance(v, str) else "; ".join(v)
    return "\n\n".join([head, *filter(None, [report.get("executive_summary")]), *(f"**{title}:** {said(report[part])}" for title, part in titled if report.get(part))])


def comparison_answer(whole: dict[str, Any], each: list[dict[str, Any]]) -> str:
    """A comparison as a chat's answer."""
    blocks = ["\n".join([f"**{e['entity_name']}**", *(f"{title}: {'; '.join(e[part])}" for title, part in (("сильные", "strengths"), ("слабые", "weaknesses")) if e.get(part))]) for e in each]
    shared = f"**Общие жалобы:** {'; '.join(whole['shared_complaints'])}" if whole.get("shared_complaints") else ""
    angle = f"**Кому какой угол:** {whole['ad_angle']}" if whole.get("ad_angle") else ""
    return "\n\n".join(filter(None, [whole.get("summary"), *blocks, shared, angle]))


def search_answer(query: str, found: list[dict[str, Any]]) -> str:
    """Chunks as a chat's answer: five titles with the first 240 characters of each."""
    if not found:
        return f"По запросу «{query}» в RAG-индексе ничего не нашлось."
    short = lambda t: t if len(t) <= 240 else t[:240] + "…"
    lines = [f"- **{f.get('title') or f.get('chunk_id')}** — {short((f.get('snippet') or '').strip().replace(chr(10), ' '))}" for f in found[:5]]
    return "\n".join([f"Нашёл {len(found)} релевантных фрагментов:", *lines])


def report(reviews: DataFrame, by: list[str], name: str, text: str, themes: dict = M.THEMES, complaints: list[str] = M.COMPLAINTS, risky: int = 5) -> DataFrame:
    """The eight parts of a report for each entity: executive_summary, ad_angle and target_audience as texts, the others as lists.

    reviews have the columns of entity_metrics, with pos; name is the entity's as it is written."""
    good, bad = _themes(reviews, by, text, themes, complaints)
    risks = M.theme_counts(E.risk_reviews(reviews, risky, by), text, {k: v for k, v in themes.items() if k in complaints}, by)
    table = M.entity_metrics(reviews, by).join(reviews.groupBy(*by).agg(F.min(name).alias("_name")), by)
    for counts, column, k in ((good, "_good", 5), (bad, "_bad", 5), (risks, "_risk", 4)):
        table = table.join(_listed(counts, by, column, k), by, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    some = lambda c: F.size(c) > 0
    first = lambda c, k: F.array_join(F.slice(c, 1, k), ", ")
    none = F.array().cast("array<string>")
    summary = F.concat_ws(
        " ",
        F.concat(F.lit("«"), "_name", F.lit("»: "), F.col("review_count").cast("string"), F.lit(" отзывов в выборке.")),
        F.concat(F.lit("Средняя оценка "), _number(F.col("avg_rating"), 1), F.lit(".")),
        F.concat(F.lit("Доля негатива "), _number(F.col("negative_pct"), 1), F.lit("%.")),
        F.concat(F.lit("Без ответа клиники "), _number(F.col("unanswered_pct"), 1), F.lit("%.")),
        F.when(some("_good"), F.concat(F.lit("Чаще всего ценят: "), first("_good", 3), F.lit("."))),
        F.when(some("_bad"), F.concat(F.lit("Чаще жалуются на: "), first("_bad", 3), F.lit("."))),
        F.lit(MADE_BY_RULE),
    )
    advice = F.array_compact(
        F.concat(
            F.array(F.when(F.col("unanswered_pct") > 15, ANSWER_MORE), F.when(F.col("negative_pct") > 20, SET_STANDARDS)),
            _hints(IMPROVEMENTS, F.slice("_bad", 1, 3), lambda t: F.concat(F.lit("Устранить повторяющуюся тему: "), t)),
        )
    )
    page = F.array_distinct(F.concat(F.array(*map(F.lit, ALWAYS_ON_PAGE)), _hints(LANDING, F.slice("_bad", 1, 2), lambda t: F.lit(None).cast("string"))))
    ad = F.when(some("_good"), F.concat(F.lit("Акцент для рекламы: "), F.get("_good", F.lit(0)), F.lit(" — формулировка из повторяющихся похвал в отзывах.")))
    about = lambda pattern: F.exists("_good", lambda t: t.rlike(pattern))
    cares = F.concat_ws(", ", F.when(about("цена|запис"), "удобство записи и цена"), F.when(about("врач|объясн|компетент"), "компетентность врача"), F.when(some("_bad"), "предсказуемость сервиса без сюрпризов"))
    risk = F.when(some("_risk"), F.col("_risk")).when(some("_bad"), F.slice("_bad", 1, 3)).otherwise(F.array(F.lit(NO_RISKS)))
    or_else = lambda c, said: F.when(F.size(c) > 0, c).otherwise(F.concat(none, F.array(F.lit(said))))
    return table.select(
        *by,
        summary.alias("executive_summary"),
        or_else(F.col("_good"), NO_PRAISE).alias("what_patients_value"),
        or_else(F.col("_bad"), NO_COMPLAINTS).alias("top_complaints"),
        or_else(advice, NO_ADVICE).alias("service_improvements"),
        page.alias("landing_page_gaps"),
        F.coalesce(ad, F.lit("Сначала соберите больше положительных отзывов для точного рекламного угла.")).alias("ad_angle"),
        F.concat(F.lit("Пациенты, которым важны "), F.coalesce(F.nullif(cares, F.lit("")), F.lit("качество приёма и предсказуемость сервиса")), F.lit(".")).alias("target_audience"),
        risk.alias("risk_topics"),
    )


def compare(reviews: DataFrame, ids: list[str], name: str, text: str, themes: dict = M.THEMES, complaints: list[str] = M.COMPLAINTS) -> tuple[DataFrame, DataFrame]:
    """Of the entities ids, in their order: strengths, weaknesses and what only one of them has; and one row on all: summary,
    shared_complaints, ad_angle and the winners by metric, unrounded; summary names those of the rounded metrics that it shows."""
    by, own = ["entity_id"], reviews.where(F.col("entity_id").isin(*ids))
    good, bad = _themes(own, by, text, themes, complaints)
    place = F.array_position(F.array(*map(F.lit, ids)), F.col("entity_id"))
    base = own.groupBy(*by).agg(F.min(name).alias("entity_name")).withColumn("position", place)  # a row for each of ids
    base = base.join(M.entity_metrics(own, by), by).join(M.response_status(own, by).select("entity_id", "answered_pct"), by)
    strong = M.top_per_group(good, by, [F.col("n").desc(), F.col("theme")], 4)
    numbered = strong.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("n").desc(), "theme")))
    unique = M.unique_themes(numbered).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "theme"))), lambda x: x["theme"]).alias("unique_selling_points"))
    said = lambda c, text_: F.coalesce(F.col(c), F.array(F.lit(text_)))
    each = base.join(_listed(good, by, "strengths", 4), by, "left").join(_listed(bad, by, "weaknesses", 4), by, "left").join(unique, by, "left")
    praised = F.get("strengths", F.lit(0))
    each = each.withColumn("_ad", F.concat(F.lit("«"), "entity_name", F.lit("» — акцент на "), praised))
    each = each.withColumns({"strengths": said("strengths", NO_PRAISE), "weaknesses": said("weaknesses", FEW_COMPLAINTS), "unique_selling_points": said("unique_selling_points", NO_PRAISE)})
    line = F.concat(
        F.lit("«"), "entity_name", F.lit("»: "), F.col("review_count").cast("string"), F.lit(" отз., рейтинг "), F.coalesce(_number(F.col("avg_rating"), 1), F.lit("—")),
        F.lit(", негатив "), F.coalesce(_number(F.col("negative_pct"), 1), F.lit("—")), F.lit("%, ответы "), F.coalesce(_number(F.col("answered_pct"), 1), F.lit("—")), F.lit("%."),
    )
    in_order = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", c.alias("v")))), lambda x: x["v"]), sep)  # of ids
    texts = each.agg(in_order(line, " ").alias("_summary"), F.nullif(in_order(F.col("_ad"), "; "), F.lit("")).alias("_ads"))
    shown = M.winners(each, "entity_name", list(WINNERS), "position")
    best = M.winners(M.compared_by(own, by).join(each.select("entity_id", "entity_name", "position"), by), "entity_name", list(WINNERS), "position")
    best = best.select(F.struct(*WINNERS).alias("winner_by_metric"))
    won = F.concat_ws("; ", *(F.concat(F.lit(f"лучший {label} — «"), F.col(c), F.lit("»")) for c, label in WINNERS.items()))
    tops = M.top_per_group(bad, by, [F.col("n").desc(), F.col("theme")], 6).select("entity_id", "theme")
    shared = M.shared_themes(tops, len(ids)).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "theme"))), lambda x: x["theme"]).alias("_shared"))
    row = texts.crossJoin(shown).crossJoin(best).crossJoin(shared)  # one row each
    whole = row.select(
        F.concat_ws(" ", "_summary", F.when(won != "", F.concat(F.lit("По метрикам: "), won, F.lit("."))), F.lit(MADE_BY_RULE)).alias("summary"),
        F.when(F.size("_shared") > 0, F.col("_shared")).otherwise(F.array(F.lit(NOTHING_SHARED))).alias("shared_complaints"),
        F.coalesce(F.concat("_ads", F.lit(".")), F.lit("Нужно больше отзывов для точных рекламных углов.")).alias("ad_angle"),
        "winner_by_metric",
    )
    return each.select("position", "entity_id", "entity_name", "strengths", "weaknesses", "unique_selling_points").orderBy("position"), whole
