"""Pages, routing, ingestion and tools on small inputs with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from opinara.functions import routing as Q
from opinara.operators import metrics as M
from opinara.operators import tables as S
from opinara.plans import ingest, tools
from opinara.sources import pages as P
from opinara.sources import readers


def page(state):
    return f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": {"preloadedState": state}}}, ensure_ascii=False)}</script></html>'


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "page_url string, html string")


def ask(spark, column, *queries):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string").select("i", column(F.col("q")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


SERVICE = {
    "city": {"cities": [{"name": "Иркутск"}]},
    "defaultLayout": {"apiBaseUrl": "https://api.example.com/"},
    "servicePage": {
        "serviceInfo": {"id": 7, "name": "УЗИ", "parentServiceName": "Диагностика", "description": "<p>a &amp; b</p>", "avgPrice": 1500},
        "breadcrumbs": [{"name": "Диагностика", "url": "/d"}],
        "clinics": [{"clinic": {"id": 1, "name": "One", "alias": "one", "fullAddress": {"city": "Иркутск"}}, "inPrice": 5, "service": {"id": 9, "name": "x"}}, {"id": 2, "alias": "two", "fullAddress": {"city": "Москва"}}],
        "additionalClinicsWithoutFilters": [{"alias": "three"}],
        "bestDoctors": [{"id": 10, "name": "D", "url": "/doctor/d", "reviewsCount": 3}],
        "reviews": [{"id": 1, "text": "own", "clinic": {"alias": "one"}}, {"id": 2, "clinic": {"alias": "two"}}, {"id": 3, "clinic": {"alias": "three"}}, {"id": 4, "clinic": {"alias": "new", "fullAddress": {"city": "Москва"}}}, {"id": 5}],
        "reviewsCount": 8,
    },
}


def test_service_page(spark):
    read = P.service_pages(table(spark, ("https://irk.example.com/service/d/u", page(SERVICE)), ("u", "<html/>"), (None, None))).collect()
    row = read[0]
    assert [r["ok"] for r in read] == [True, False, False]
    assert [json.loads(r)["id"] for r in row["reviews"]] == [1, 5] and row["reviews_dropped_other_city"] == 3
    assert [(c["clinic_alias"], c["city"], c["service_card_id"]) for c in row["clinics"]] == [("one", "Иркутск", 9)]
    assert (row["description_plain"], row["target_city_name"], row["city_slug"], row["reviews_count_total"]) == ("a & b", "Иркутск", "irk", 8)


def test_doctor_cards_and_feed(spark):
    pages = table(spark, ("https://irk.example.com/service/d/u", page(SERVICE)), ("u", "<html/>"))
    (card,) = P.best_doctors(P.service_pages(pages)).collect()
    assert (card["doctor_id"], card["profile_url"], card["service_id"], card["parent_service_name"]) == (10, "https://irk.example.com/doctor/d", 7, "Диагностика")
    (feed,) = P.review_feed(pages, "/reviews").collect()
    assert feed["url"] == "https://api.example.com/reviews?serviceId=7&offset=5&filter=0&sort=0" and feed["total"] == 8


def test_doctor_page(spark):
    state = {"doctorPage": {"doctorInfo": {"id": 3, "fullName": "Dr", "rating": 9.5, "about": "<b>x</b>"}, "reviews": [{"id": 1, "text": " t ", "rating": {"value": 8, "label": "ok"}}, {"id": 2, "rating": 5}]}}
    row, none = P.doctor_pages(table(spark, ("https://h/doctor/dr/?a=1", page(state)), ("u", ""))).collect()
    assert (row["doctor_alias"], row["doctor"]["name"], row["doctor"]["total_rating"], row["description_plain"], row["reviews_count_total"]) == ("dr", "Dr", 9.5, "x", 2)
    assert [(r["text"], r["rating_value"], r["rating_label"]) for r in row["reviews"]] == [("t", 8.0, "ok"), ("", 5.0, None)]
    assert not none["ok"] and none["reviews"] == []


def test_clinic_page(spark):
    cards, med = [{"id": 4, "name": "C", "alias": "c", "rating": 9.0}], {"12": {"name": "Dir", "prices": [{"id": 1, "name": "S", "price": 10.0}, {"id": 2}]}}
    quote = lambda v: json.dumps(v).replace('"', "&quot;")
    html = f'<div :clinics="{quote(cards)}" :med-services="{quote(med)}"></div><input name="clinicId" value="4"><x :total-reviews-count="3"><i itemtype="http://schema.org/Review">'
    row, none = P.clinic_pages(table(spark, ("https://msk.h/clinic/c-alias#reviews", html), ("u", "<p>"))).collect()
    assert (row["clinic_alias"], row["clinic"]["id"], row["clinic_id"], row["reviews_count_total"], row["reviews_loaded_count"], row["reviews_incomplete"]) == ("c-alias", 4, 4, 3, 1, True)
    assert [(r["direction_key"], r["service_id"], r["price"]) for r in row["service_catalog"]] == [("12", 1, 10.0), ("12", 2, None)]
    assert none["clinic"] is None and none["service_catalog"] == [] and not none["reviews_incomplete"]


def test_saved_source(spark):
    saved = '<td class="line-content"><span class="t">&lt;p&gt;</span>x</td><td class="line-content">&lt;/p&gt;</td>'
    assert ask(spark, P.page_source, saved, "<p>", None) == ["<p>x</p>", "<p>", None]


def test_link_lists(spark):
    html = '<ul><li><a href="/auto/a">A</a><a href="/b">B</a></li></ul><div class="pager"><a class="next" href="?p=2"></a><a class="x" href="?p=3"></a></div><div class="product-list"><div class="item"><a class="product-name" href="/r/1"><br>n</a></div></div><a class="product-name" href="/r/2"></a>'
    base = "https://example.com/map/"
    (found,) = spark.createDataFrame([(html,)], "h string").select(P.category_links(F.col("h"), base, "/auto/"), P.product_links(F.col("h"), base), P.pager_links(F.col("h"), base)).collect()
    assert list(found) == [["https://example.com/auto/a"], ["https://example.com/r/1"], ["https://example.com/map/?p=2"]]


def test_shop_reviews(spark):
    item = '<li class="comments__item"><p class="feedback__header"> Ann </p><span class="feedback__rating star4"></span><div class="feedback__date">Today</div><span class="feedback__text--item"><span class="feedback__text--item-bold">Достоинства:</span> good</span><span class="feedback__text--item"><span class="feedback__text--item-bold">Комментарий:</span> fine</span></li>'
    html = f'<ul class="comments__list">{item}<li class="comments__item"><span class="feedback__text--item">plain</span></li></ul>'
    full, none = ask(spark, P.shop_reviews, html, None)
    assert [tuple(r) for r in full] == [("Ann", 4, "Today", "fine"), ("Аноним", 0, "Не найдено", "plain")] and none == []


def test_discovered_services(spark):
    df = lambda *h: spark.createDataFrame([(x,) for x in h], "html string")
    urls, stats = P.discovered_services(df('<a href="/service/a/b">'), df('<a href="/service/a/b"><a href="/service/a/c">', ""))
    assert urls.count() == 2 and tuple(stats.first()) == (1, 2, 2)


def test_routes(spark):
    found = ask(spark, Q.route, "отзывы о клинике", "айфон или ноутбук", "сравни их", "погода", None, "клиника и товар")
    assert [(r["system"], r["confidence"]) for r in found] == [("clinics", 0.85), ("general", 0.7), ("clinics", 0.55), ("general", 0.4), ("general", 0.4), ("clinics", 0.7)]
    (kept,) = ask(spark, lambda q: Q.sticky(Q.route(q), F.lit("clinics")), "погода")
    assert tuple(kept) == ("clinics", 0.65)


@pytest.mark.parametrize(
    "query,intent,kind,entities,confidence",
    [
        ("Сравни «Альфа» и «Бета»", "reputation_compare", "clinic", ["Альфа", "Бета"], 0.9),
        ("сравни врача Иванов и Петров.", "reputation_compare", "doctor", ["врача Иванов", "Петров"], 0.7),
        ("проанализируй репутацию по клинике Альфа", "reputation_analyze", "clinic", ["Альфа"], 0.75),
        ("разбери", "reputation_analyze", "clinic", [], 0.45),
        ("что пишут про Гамма?", "rag_search", None, ["пишут про Гамма"], 0.5),  # the first of про and о, as a part of a word too
        ("покажи отзывы «Гамма»", "rag_search", None, ["Гамма"], 0.5),
        ("привет", "fallback", None, [], 0.2),
        (None, "fallback", None, [], 0.2),
    ],
)
def test_intents(spark, query, intent, kind, entities, confidence):
    (row,) = ask(spark, Q.intent, query)
    assert (row["intent"], row["entity_kind"], row["entities"], row["confidence"]) == (intent, kind, entities, confidence)


@pytest.mark.parametrize(
    "query,last,expected",
    [
        ("а теперь «Бета»", ("reputation_analyze", "clinic", ["А"]), ("reputation_analyze", "clinic", ["Бета"], 0.7)),
        ("а теперь «Бета»", ("rag_search", "clinic", ["А"]), ("rag_search", "clinic", ["Бета"], 0.75)),
        ("ясно", ("rag_search", "clinic", ["А"]), ("fallback", "clinic", ["А"], 0.2)),
        ("ясно", None, ("fallback", None, [], 0.2)),
    ],
)
def test_sessions_fill_in(spark, query, last, expected):
    df = spark.createDataFrame([(query, last)], "q string, last struct<intent: string, entity_kind: string, entities: array<string>>")
    assert tuple(df.select(Q.in_session(F.col("q"), Q.intent(F.col("q")), F.col("last")).alias("v")).first()["v"]) == expected


def test_question_parts(spark):
    assert ask(spark, Q.question_kind, "что лучше", "плюсы", "тон", "x") == ["comparison", "pros_cons", "sentiment", "product_lookup"]
    assert ask(spark, Q.capitalised, "Покупать Galaxy, (Pixel) или Nokia! Sony", None) == [["Покупать", "Galaxy", "Pixel"], []]
    assert ask(spark, lambda q: Q.search_text("x", q, ["top_praises"]), "УЗИ") == [f"УЗИ. {Q.DEFAULT_SEARCH['service']}. похвала"]
    assert Q.chunk_kinds(["best_doctor", "landing_page_gaps"]) == ["review", "doctor", "service"]


CRAWL = {
    "target_city_name": "Иркутск",
    "services": [
        {"ok": True, "page_url": "p", "service": {"id": 1, "name": "S", "avg_price": 10.0, "synonyms": ["a", "b"]}, "breadcrumbs": [{"name": "Dir"}], "clinics": [{"clinic_alias": "a"}], "doctors": [{"doctor_id": 10, "name": "D", "speciality": "Sp", "reviews_count": 2}, {"doctor_id": 10, "name": "E"}, {"doctor_id": 11, "name": "F"}], "reviews": [{"review_id": 1, "text": "x", "answer": "y", "service_name": "S", "clinic_name": "C"}, {"review_id": 2, "text": "z", "clinic_city": "Москва"}, {"review_id": 3, "text": "z", "clinic_alias": "q"}, {"review_id": 1, "text": "again"}]},
        {"ok": True, "service": {"id": 2, "name": "Empty"}, "reviews": []},
        {"ok": False, "service": {"id": 3, "name": "No"}},
    ],
    "clinics": [{"ok": True, "clinic_alias": "a", "clinic": {"id": 5}}, {"ok": True, "clinic_alias": "b", "clinic": {"id": 6}}],
    "doctor_profiles": [{"ok": True, "doctor": {"id": 1, "reviews_count": 0}}],
}


def crawl(spark, tmp_path):
    (tmp_path / "crawl.json").write_text(json.dumps(CRAWL, ensure_ascii=False))
    return readers.crawl(spark, str(tmp_path / "crawl.json"))


def test_ingest_crawl(spark, tmp_path):
    found, counts = ingest.ingest_crawl(crawl(spark, tmp_path))
    assert {(r["entity"], r["reason"]): r["n"] for r in counts.collect()} == {
        ("services", "inserted"): 1, ("services", "skipped_empty"): 1, ("doctors", "inserted"): 1, ("doctors", "skipped_empty"): 1, ("clinics", "inserted"): 1, ("clinics", "skipped_empty"): 1,
        ("profiles", "skipped_empty"): 1, ("reviews", "inserted"): 1, ("reviews", "skipped_other_city"): 1, ("reviews", "skipped_unknown_clinic"): 1,
    }
    assert {r["text"] for r in found["reviews"].where("reason is null").collect()} == {"x"}


def test_chunks_of_a_crawl_and_their_index(spark, tmp_path):
    chunks = ingest.crawl_chunks(crawl(spark, tmp_path))
    rows = {(r["kind"], r["ref"]): r for r in chunks.collect()}
    assert sorted(rows) == [("doctor", "10"), ("doctor", "11"), ("review", "1"), ("review", "2"), ("review", "3"), ("service", "1"), ("service", "2")]
    assert rows["service", "1"]["body"] == "Услуга: S\nНаправление: Dir\nСредняя цена: 10.0\nСинонимы: a, b" and rows["service", "1"]["tags"] == "catalog"
    assert (rows["doctor", "10"]["title"], rows["doctor", "10"]["body"]) == ("D — Sp", "Врач: D\nСпециальность: Sp\nЧисло отзывов: 2")
    assert (rows["review", "1"]["title"], rows["review", "1"]["body"], rows["review", "2"]["title"]) == ("S — C", "x\n\n[Ответ клиники]: y", "Отзыв #2")
    stored = spark.createDataFrame([("service", "1", [1.0])], "kind string, ref string, embedding array<double>")
    made = ingest.build_index(chunks, stored, lambda df: df.withColumn("embedding", F.array(F.lit(2.0))))
    assert sorted((r["kind"], r["embedding"][0]) for r in made.where("kind = 'service'").collect()) == [("service", 1.0), ("service", 2.0)] and made.count() == 7


def test_ingest_reviews_and_analysis(spark):
    new = spark.createDataFrame([(1, "a", "Хороший товар"), (1, "a", "Хороший товар"), (1, "b", "-"), (1, "c", "known text")], "source_id int, external_id string, text string")
    rows = ingest.ingest_reviews(new, new.where("external_id = 'c'")).collect()
    assert [(r["external_id"], r["ai_rating"], r["summary"]) for r in rows] == [("a", 4, "Хороший товар")]
    answers = spark.createDataFrame([('```{"rating": 9, "sentiment": "positive", "summary": "s", "tags": ["a", " ", "b"]}',), ("no json",), (None,)], "answer string")
    assert [tuple(r)[1:] for r in ingest.analysed(answers, "answer").collect()] == [(5, "positive", "s", "a, b"), (4, "", "no json", ""), (4, "", "", "")]


def test_ingest_chat(spark):
    rows = [("k", 1, "Посоветуйте, пожалуйста, хороший магазин", None), ("k", 2, "", None), ("k", 3, "ответ по делу, спасибо большое", 1), ("k", 4, "old message here", None), ("k", 5, "Вебинар! Не пропустите прямой эфир https://zoom.us/j/1 код доступа: 5", None)]
    new = spark.createDataFrame(rows, "export_key string, message_id long, text string, reply_to long")
    kept = {r["message_id"]: r for r in ingest.ingest_chat(new, new.where("message_id = 4")).collect()}
    assert sorted(kept) == [1, 3, 5] and kept[3]["body"] == "[ответ на #1] ответ по делу, спасибо большое"
    assert kept[5]["spam_or_ad"] and kept[5]["embed_text"] is None and not kept[1]["spam_or_ad"] and kept[1]["embed_text"].endswith("магазин")


def test_tools(spark, tmp_path):
    rows = spark.createDataFrame([("positive", "a, b"), ("негатив", "a"), ("", None)], "sentiment string, tags string")
    row = tools.product_insight(rows, "X").first()
    assert (row["positive"], row["negative"], row["neutral"], row["top_tags"]) == (1, 1, 1, ["a", "b"]) and row["summary"].endswith("Частые теги: a, b.")
    none = tools.product_insight(rows.limit(0), "X").first()
    assert none["top_tags"] == [] and none["summary"].endswith("нет данных.")
    found = tools.default_tools()
    assert found.run("top_tags", citations=rows, n=1).first()["topic"] == "a"
    with pytest.raises(KeyError):
        found.run("unknown")
    assert tools.has_source(spark.createDataFrame([(1, "a")], "source_id int, external_id string"), 1, "a")


def test_empty_inputs(spark):
    none = table(spark)
    for read in (P.service_pages(none), P.clinic_pages(none), P.doctor_pages(none), P.review_feed(none, "/r")):
        assert read.collect() == []
    assert M.topic_counts(spark.createDataFrame([], "t string"), "t").collect() == [] and S.keep_first(none, ["page_url"], [F.col("html")]).count() == 0
