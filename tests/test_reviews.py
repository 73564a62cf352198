"""Exact expectations for reviews: metrics, grouping, comparison, retrieval, texts, chats."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.functions import vectors as V
from opinara.operators import entities as E
from opinara.operators import metrics as M
from opinara.operators import tables as S
from opinara.plans import reputation as R
from opinara.plans import search as H
from opinara.sources import readers, sinks
from opinara.streaming import jobs

REVIEW = "review_id long, text string, answer string, rating_value double, rating_clinic double, clinic_name string, clinic_alias string, clinic_city string, doctor_id long, doctor_name string, service_name string, parent_service_name string, category_direction_title string, created string, patient_public_name string"


def reviews(spark, *rows):
    """rows: dicts; what they lack is null."""
    names = [c.split()[0] for c in REVIEW.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], REVIEW)
    return R.canonical_reviews(df).withColumn("entity_id", F.lit("e")).withColumn("pos", F.col("review_id"))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def four(spark):
    return reviews(spark, *({"review_id": i, "rating_value": r, "answer": a, "text": "t"} for i, r, a in [(1, 4.0, ""), (2, 10.0, None), (3, 5.0, " "), (4, 9.0, "Спасибо")]))


def test_metrics(spark):
    two = reviews(spark, {"review_id": 1, "rating_value": 10.0, "answer": "Спасибо"}, {"review_id": 2, "rating_clinic": 4.0, "answer": ""})
    (m,) = M.entity_metrics(two, ["entity_id"]).collect()
    assert (m["review_count"], m["unanswered_pct"], m["negative_pct"]) == (2, 50.0, 50.0)
    (d,) = M.rank_metrics(four(spark), ["entity_id"]).collect()
    assert (d["review_count"], d["negative_unanswered"], d["median_rating"], d["p10_rating"]) == (4, 2, 9.0, 4.0)
    (s,) = M.response_status(four(spark), ["entity_id"]).collect()
    assert (s["total"], s["answered"], s["unanswered"], s["answered_pct"]) == (4, 1, 3, 25.0)
    assert [r["review_id"] for r in E.risk_reviews(four(spark), 2).collect()] == [1, 3]


@pytest.mark.parametrize("seed", range(5))
def test_rank_metrics_are_by_index(spark, seed):
    rng = random.Random(seed)
    ratings = [rng.choice([None, *range(11)]) for _ in range(rng.randint(1, 60))]
    own = reviews(spark, *({"review_id": i, "rating_value": None if r is None else float(r)} for i, r in enumerate(ratings)))
    (m,) = M.rank_metrics(own, ["entity_id"]).collect()
    rated = sorted(r for r in ratings if r is not None)
    n = len(rated)
    assert (m["median_rating"], m["p10_rating"]) == ((rated[n // 2], rated[max(0, int(n * 0.1) - 1)]) if n else (None, None))


def test_grouping_and_keys(spark):
    own = reviews(spark, {"review_id": 1, "clinic_alias": "a"}, {"review_id": 2, "clinic_alias": "b"}, {"review_id": 3, "clinic_alias": "a"}, {"review_id": 3, "clinic_alias": "a"})
    assert [tuple(r) for r in E.group_reviews(own, "clinic", 5).collect()] == [("a", 2), ("b", 1)]
    one = reviews(spark, {"review_id": 1, "service_name": "УЗИ", "parent_service_name": "Диагностика", "doctor_id": 0})
    keys = [one.select(E.entity_key(k)).first()[0] for k in ("service", "category", "doctor", "clinic")]
    assert keys == ["Диагностика/УЗИ", "Диагностика", "unknown", "unknown"]
    names = spark.createDataFrame([("t", "Удаление тонзиллор"), ("u", "УЗИ")], "entity_id string, entity_name string")
    counts = spark.createDataFrame([("u", 2)], "entity_id string, review_count long")
    assert {r["entity_id"]: r["review_count"] for r in E.seeded_groups(names, counts).collect()} == {"t": 0, "u": 2}


def test_themes(spark):
    own = spark.createDataFrame([("Долгое ожидание, очереди",), ("Врач всё объяснил, грамотный",), (None,)], "text string")
    found = {r["theme"] for r in M.theme_counts(own, "text").collect()}
    assert "долгое ожидание и очереди" in found and "понятные объяснения врача" in found


def test_comparison(spark):
    rows = spark.createDataFrame([("a", 7.5, 30.0, 10, 0), ("b", 9.5, 80.0, 4, 1)], "entity_id string, avg_rating double, answered_pct double, review_count int, position int")
    assert tuple(R.winners(rows).first()) == ("b", "b", "a")
    service = ["Промывание миндалин"] * 3 + ["УЗИ"] * 4 + ["Промывание  миндалин"] * 2 + ["ЭКГ"] * 3
    own = reviews(spark, *({"review_id": i, "service_name": s, "rating_value": 5.0} for i, s in enumerate(service))).withColumn("entity_id", F.when(F.col("review_id") < 7, "A").otherwise("B"))
    found = {r["entity_id"]: (r["total"], r["reviews_before_scope"], r["status"]) for r in R.compare(own, ["A", "B", "C"], {"scope_service": "промывание миндалин", "other": "x"}).collect()}
    assert found == {"A": (3, 7, "ok"), "B": (2, 5, "ok"), "C": (None, None, "not_found")}
    for ids, scope, code in ((["A"], None, "need_at_least_two"), (list("ABCDEFG"), None, "too_many"), (["A", "B"], {"service": "нет такой"}, "scope_filtered_out")):
        with pytest.raises(R.CompareError, match=code):
            R.compare_checked(own, ids, scope)


def test_dedupe(spark):
    rows = [(1, 0, "x"), (2, 0, "x"), (1, 1, "x"), (3, 1, "x")]
    own = reviews(spark, *({"review_id": i, "text": t} for i, _, t in rows)).drop("pos")
    own = own.withColumn("src_order", F.lit(0)).withColumn("pos", F.monotonically_increasing_id())
    assert sorted(r["review_id"] for r in S.reviews_deduped(own).collect()) == [1, 2, 3]
    odd = reviews(spark, {"review_id": 0, "text": "x"}, {"text": " "}, {"review_id": 5}, {"text": "only text"}).withColumn("src_order", F.lit(0))
    found = [r["review_id"] for r in S.reviews_deduped(odd).collect()]
    import zlib

    assert sorted(found) == sorted([5, zlib.crc32("||only text|".encode()) & 0x7FFFFFFF])
    merged = S.merge_keep_last(spark.createDataFrame([(1, "a", 0), (2, "b", 1), (1, "c", 2)], "id int, v string, pos int"), F.col("id"), "pos")
    assert sorted((r["pos"], r["v"]) for r in merged.collect()) == [(0, "c"), (1, "b")]


def test_upsert_and_city(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 0), (2, "d", 1), (3, "e", 2)], "id int, v string, pos int")
    assert sorted(tuple(r) for r in S.upsert(old, new, ["id"], "pos").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    own = reviews(spark, *({"review_id": i, "clinic_alias": f"c{i}", "clinic_city": c} for i, c in enumerate(["Иркутск", "Москва", None, "иркутск"])))
    known = spark.createDataFrame([("c1", "Иркутск"), ("c3", "Москва")], "clinic_alias string, city string")
    assert sorted(r["review_id"] for r in S.in_city(own, known, "Иркутск").collect()) == [0, 1, 2]


def test_vectors(spark):
    of = lambda *x: F.array(*map(F.lit, x))
    assert value(spark, V.cosine(of(0.6, 0.8), of(0.6, 0.8))) == pytest.approx(1)
    assert [value(spark, V.cosine(a, b)) for a, b in ((of(1.0, 0.0), of(0.0, 1.0)), (of(1.0), of(1.0, 2.0)), (of(0.0), of(0.0)), (of(1.0), of(-1.0)))] == [0, 0, 0, 0]
    assert value(spark, V.fit(of(1.0, 2.0, 3.0), 2)) == [1, 2] and value(spark, V.fit(of(1.0), 3)) == [1, 0, 0]


def test_retrieval(spark):
    rows = [(1, [0.5, math.sqrt(0.75)], "one"), (2, [1.0, 0.0], "two"), (3, None, "three")]
    own = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, body string")
    near = H.vector_candidates(own, [1.0, 0.0], 3)
    assert [r["chunk_id"] for r in near.orderBy("vector_rank").collect()] == [2, 1, 3]
    both = H.merged(near, H.keyword_candidates(own, "one", ["body"], 3), ["chunk_id"])
    assert [r["chunk_id"] for r in H.rerank(both, "query", [1.0, 0.0], 2, 3).collect()] == [2, 1]
    full = own.withColumn("title", F.lit("")).withColumn("tags", F.lit(""))
    assert [r["chunk_id"] for r in H.hybrid_search(full, "three", None, 2).collect()] == [3]


def test_texts(spark):
    lit = F.lit
    assert [value(spark, T.is_review_text(lit(x))) for x in ("Хороший товар", "-", " .  ", None)] == [True, False, False, False]
    overlap = [value(spark, T.lexical_overlap(lit(a), lit(b))) for a, b in (("длинные очереди", "очереди и ожидание"), ("", "x"), ("слово", "другое"))]
    assert overlap[0] > 0 and overlap[1:] == [0, 0]
    assert value(spark, T.lenient_object(lit('prefix {"a": {"b": 1}} suffix'))) == '{"a": {"b": 1}}'
    assert value(spark, T.lenient_array(lit('```json\n{"rows": [1, 2]}\n```'))) == "[1, 2]"
    assert [value(spark, T.round_exact(lit(x), n)) for x, n in ((86.25, 1), (2.675, 2), (1.005, 2))] == [86.2, 2.67, 1.0]
    assert value(spark, T.export_key(lit(1448120171), lit("Name"))) == "1448120171"
    assert value(spark, T.export_key(lit(None).cast("long"), lit("Мой чат"))) == "name:Мой_чат"
    assert value(spark, T.promotion(lit("Приглашаем вас на вебинар! https://zoom.us/j/1")))["spam"]
    assert not value(spark, T.promotion(lit("Какие у вас впечатления от новой версии, стоит ли обновляться? " * 3)))["spam"]
    assert value(spark, T.plain_text(lit("<p>a &amp; b</p>\n<i>c</i>"))) == "a & b c"
    assert value(spark, T.plain_text(lit("<p>a&amp</p> &copy; &#65;&#x42; &amp;lt; &ampx; &nosuch;"), closed=True)) == "a&amp © AB &lt; &ampx; &nosuch;"
    assert value(spark, T.plain_text(lit("<p>a&amp</p>"))) == "a&" and value(spark, T.plain_text(lit(None).cast("string"), closed=True)) is None
    assert value(spark, T.city_name(lit(None).cast("string"), lit("https://irk.example.org/x"))) == "Иркутск"
    assert value(spark, T.mentions(lit("Сеть Мед Лайн плюс"), "мед лайн")) and not value(spark, T.mentions(lit("x"), " "))
    assert value(spark, T.review_time(lit("2024-05-06"))).day == 6 and value(spark, T.review_time(lit("x"))) is None


def test_crawl(spark, tmp_path):
    doc = {"services": [{"service": {"id": 1, "name": "S"}, "clinics": [{"clinic_alias": "a"}], "doctors": [{"doctor_id": 10}, {"doctor_id": 10}], "reviews": [{"review_id": 1, "text": "x"}, {"review_id": 2}]}], "clinics": [{"clinic_alias": "a", "clinic": {"id": 5}}, {"clinic_alias": "b"}], "reviews": [{"review_id": 1, "text": "later"}, {"text": "no id"}]}
    (tmp_path / "crawl.json").write_text(json.dumps(doc, indent=1))
    read = readers.crawl(spark, str(tmp_path / "crawl.json"))
    kept = S.reviews_deduped(readers.crawl_reviews(read)).collect()
    assert len(kept) == 3 and {r["text"] for r in kept} == {"x", None, "no id"}
    services, clinics, doctors = readers.crawl_entities(read)
    assert services.first()["has_reviews"] and [r["clinic_alias"] for r in clinics.collect()] == ["a"] and doctors.count() == 1


def test_the_first_of_equal_ids_is_of_the_first_document(spark, tmp_path):
    page = lambda text: {"services": [{"reviews": [{"review_id": 7, "text": text}]}], "reviews": [{"review_id": 8, "text": text}]}
    for part in range(3):
        lines = [json.dumps(page(f"{part}-{i}")) for i in range(40)]
        (tmp_path / f"{part}.json").write_text("\n".join(lines))
    kept = S.reviews_deduped(readers.crawl_reviews(readers.crawl(spark, str(tmp_path), lines=True).repartition(5))).collect()
    assert {(r["review_id"], r["text"]) for r in kept} == {(7, "0-0"), (8, "0-0")}


def test_chat_export(spark, tmp_path):
    messages = [
        {"type": "message", "id": 1, "date": "2024-01-02T03:04:05", "from": "A", "text": "plain"},
        {"type": "message", "id": 2, "date_unixtime": "1700000000", "actor": "B", "text": ["see ", {"type": "link", "text": "this"}], "photo": "p.jpg"},
        {"type": "message", "id": 3, "text": "", "poll": {"question": "Q?", "answers": [{"text": "yes"}, {"text": "no"}]}},
        {"type": "service", "id": 4, "text": "joined"},
    ]
    (tmp_path / "chat.json").write_text(json.dumps({"id": 7, "name": "N", "messages": messages}))
    rows = {r["message_id"]: r for r in readers.chat_messages(spark, str(tmp_path / "chat.json")).collect()}
    assert [rows[i]["text"] for i in (1, 2, 3)] == ["plain", "see this", "Q?\nyes\nno"] and 4 not in rows
    assert rows[2]["author"] == "B" and rows[2]["media"] == "photo" and rows[2]["sent_at"].year == 2023 and rows[1]["export_key"] == "7"
    sinks.by_year(readers.chat_messages(spark, str(tmp_path / "chat.json")), str(tmp_path / "out"), [2023])
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_pages_and_chunks(spark, tmp_path):
    html = '<div itemprop="review"><span itemprop="author">Ann</span><meta itemprop="ratingValue" content="9"><p itemprop="reviewBody">Good one</p></div><div itemprop="review"><p itemprop="reviewBody"> </p></div>'
    (row,) = readers.page_reviews(spark.createDataFrame([("u", html)], "url string, html string")).collect()
    assert (row["patient_public_name"], row["rating_value"], row["text"]) == ("Ann", 9.0, "Good one")
    own = reviews(spark, {"review_id": 100, "text": "t", "answer": "a"}, {"review_id": 0, "text": "t"}, {"review_id": 5, "text": " "})
    (chunk,) = readers.review_chunks(own).collect()
    assert (chunk["kind"], chunk["ref"], chunk["tags"]) == ("review", "100", "answered")
    runs = spark.createDataFrame([(1, "p", "2024-01-01", 0.5, 'say "x"\nnow', 2)], "id int, product_name string, created_at string, confidence double, summary string, source_id int")
    sinks.insights_csv(runs, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["summary"] == "say 'x' now"


def test_polling_ingest_skips_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for part in range(2):
        rows.union(spark.createDataFrame([(10 + part, "n")], "id int, v string")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.poll(spark, str(tmp_path / "in"), "id int, v string", str(tmp_path / "out"), str(tmp_path / "check"), ["id"], None).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 10, 11]
