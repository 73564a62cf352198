"""Fields, filters, views and the chat's dispatch."""

import difflib
import json
import random

from pyspark.sql import functions as F

from opinara.functions import text as T
from opinara.operators import entities as E
from opinara.plans import research as C
from opinara.plans.tools import Tools

REVIEW = "clinic_alias string, clinic_name string, doctor_id long, doctor_name string, service_name string, parent_service_name string, category_direction_title string"


def test_fields():
    assert [f.key for f in C.fields_of(preset="category_landscape")][:2] == ["reviews_count", "avg_rating"]
    assert C.fields_of(["avg_rating", "own"], "category_landscape") == [C.Field("avg_rating", "metric", "Средняя оценка"), C.Field("own", "text", "own")]
    assert len(C.fields_of([], "unknown")) == 8


def test_entity_filters(spark):
    df = spark.createDataFrame([(" a ", "A", 5, "D", "S", "P", None), ("", "A", 0, "D", None, " ", "Dir"), (None,) * 7], REVIEW)
    rows = df.select(*(C.entity_filter(k).alias(k) for k in ("clinic", "service", "category", "doctor"))).collect()
    assert [r["clinic"] for r in rows] == [{"clinic_alias": "a"}, {"clinic_name_like": "A"}, {}]
    assert [r["doctor"] for r in rows] == [{"doctor_external_id": "5"}, {"doctor_name_like": "D"}, {}]
    assert [r["category"] for r in rows] == [{"parent_service_name": "P"}, {"parent_service_name": "Dir"}, {}] and rows[0]["service"] == {"service_name": "S", "parent_service_name": "P"}
    chunks = spark.createDataFrame([("review", "Alpha"), ("doctor", "alphabet"), ("review", "B")], "kind string, clinic_name string")
    assert C.filtered_chunks(chunks, {"clinic_name_like": "alpha"}, ["review"]).count() == 1 and C.filtered_chunks(chunks, {}).count() == 3


def test_views_and_pages_of_an_api(spark):
    row = C.search_view(spark.createDataFrame([(1, "x" * 500, 0.5)], "chunk_id int, body string, score double")).first()
    assert len(row["snippet"]) == 400 and "body" not in row.asDict()
    risky = C.risk_view(spark.createDataFrame([(1, 2.0, False, "y" * 600)], "review_id long, rating double, answered boolean, text string")).first()
    assert len(risky["text"]) == 500 and risky["doctor_name"] is None
    raw = spark.createDataFrame([(i, json.dumps({"id": i, "text": "t", "clinic": {"alias": "a" if i % 2 else "b"}})) for i in range(8)], "pos int, body string")
    clinics = spark.createDataFrame([("a", "Иркутск"), ("b", "Москва")], "clinic_alias string, city string")
    kept, dropped = C.api_reviews(raw, "body", "pos", 5)
    assert kept.count() == 5 and dropped.first()["dropped"] == 0
    kept, dropped = C.api_reviews(raw, "body", "pos", 5, clinics, "иркутск")
    assert {r["review_id"] for r in kept.collect()} == {1, 3} and dropped.first()["dropped"] == 3


def test_chat(spark):
    tools = Tools()
    for name in ("reputation_compare", "reputation_analyze", "rag_search"):
        tools.register(name, lambda name=name, **given: (name, given["entity_kind"], given["entities"]), "chat")
    assert C.chat(spark, "сравни «А1» и «Б2»", tools)["result"] == ("reputation_compare", "clinic", ["А1", "Б2"])
    assert C.chat(spark, "а теперь «Б2»", tools, ("reputation_analyze", "doctor", ["А1"]))["result"] == ("reputation_analyze", "doctor", ["Б2"])
    assert C.chat(spark, "привет", tools)["result"] == ("rag_search", "clinic", [])
    assert C.chat(spark, "разбери", tools)["error"] == "need_entities" and C.chat(spark, "привет", tools, override="reputation_analyze")["error"] == "need_entities"


def test_suggestions_are_by_substring_then_by_difflib(spark):
    names = ["Клиника Альфа", "Альфа Центр", "Бета", "Alphabet", "Alpine"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"] for r in E.suggest(df, "альфа").collect()} == {"Клиника Альфа", "Альфа Центр"}
    assert [r["name"] for r in E.suggest(df, "Alphabit").collect()] == difflib.get_close_matches("Alphabit", names, 5, 0.5) == ["Alphabet", "Alpine"]
    assert E.suggest(df, "zzz").count() == 0
    assert [r["name"] for r in E.suggest(spark.createDataFrame([("diet",)], "name string"), "tide").collect()] == ["diet"]  # not the other way round


def test_suggestions_are_those_of_difflib(spark):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(300)}) + ["a" * 250 + "b"]
    df = spark.createDataFrame([(n,) for n in names + names[:20]] + [(None,)], "name string")
    for wanted in ("abecad", "édcba", "aab" * 3, "x", "abc" * 80):
        if any(wanted in n for n in names):
            continue
        found = E.suggest(df, wanted, 7).collect()
        assert [r["name"] for r in found] == difflib.get_close_matches(wanted, names, 7, 0.5)
        bounds = df.select("name", E.likeness_bound(F.col("name"), wanted).alias("b")).where("name is not null").collect()
        assert all(r["b"] == difflib.SequenceMatcher(None, r["name"], wanted).quick_ratio() for r in bounds)


def test_rounding_is_of_the_binary_value(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 2.675, 1.005, 86.25, 0.125, -0.375, 2.5, 3.5, 0.5, 1e-300, 5e-324, 1e300, 2.0**52 + 0.5, 2.0**53, 0.05, 0.15, 0.25, 0.35, 1e15 + 0.3, float("inf"), float("-inf")]
    values += [rng.uniform(-100, 100) for _ in range(500)] + [rng.randint(-2000, 2000) / 2 ** rng.randint(1, 12) for _ in range(500)] + [rng.randint(0, 10**7) / 10**4 for _ in range(500)]
    values += [rng.uniform(0.1, 10) * 10.0 ** rng.randint(-12, 18) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    places = (0, 1, 2, 3, 4, 9, 15)
    for r in df.select("v", *(T.round_exact(F.col("v"), p).alias(f"p{p}") for p in places)).collect():
        for p in places:
            want = None if r["v"] is None else r["v"] if r["v"] != r["v"] or abs(r["v"]) == float("inf") else round(r["v"], p)
            assert str(r[f"p{p}"]) == str(want), (r["v"], p)
