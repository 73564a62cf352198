"""Phases, jobs, drains, backups, polling, sessions, salvage and reports by rule."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from opinara import storage
from opinara.functions import routing
from opinara.functions import text as T
from opinara.operators import entities as E
from opinara.operators import metrics as M
from opinara.operators import tables as S
from opinara.plans import heuristics, ingest, tools
from opinara.plans import jobs as work
from opinara.plans import reputation as R
from opinara.sources import pages, readers, sinks
from opinara.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_drain_ends_where_it_should():
    feed = list(range(23))
    asked = []

    def fetch(offset):
        asked.append(offset)
        return feed[offset : offset + 8], None, None

    assert list(work.drain(fetch, size=5, total=23)) == feed and asked == [0, 5, 10, 15, 20]
    assert list(work.drain(lambda o: (feed[o : o + 5], 7, None), size=5)) == feed[:10]
    assert list(work.drain(lambda o: ([1, 2], None, None), size=5)) == [1, 2]
    assert list(work.drain(lambda o: ([], None, "down"), size=5)) == []
    assert list(work.drain(lambda o: ([None] * 5, None, None), size=5)) == []
    assert len(list(work.drain(lambda o: ([o] * 5, None, None), size=5, most=3))) == 15
    assert list(work.drain(fetch, keep=lambda r: r % 2 == 0, size=5, total=23))[:3] == [0, 2, 4]
    assert list(work.drain(fetch, offset=23, total=23)) == []


def test_jobs_go_through_their_states():
    def act(n):
        if n < 0:
            raise ValueError("negative")
        return n * 2

    queue = work.Jobs(act)
    good, bad = queue.submit(n=2), queue.submit(n=-1)
    for _ in range(200):
        if queue.get(bad)["status"] in ("completed", "failed"):
            break
        time.sleep(0.02)
    assert queue.get(good)["status"] == "completed" and queue.get(good)["result"] == 4
    assert queue.get(bad)["status"] == "failed" and queue.get(bad)["error"] == "negative" and queue.get("none") is None
    queue.close()
    slow = work.Jobs(lambda: time.sleep(0.3), most=1)
    slow.submit()
    time.sleep(0.05)
    slow.submit()
    with pytest.raises(RuntimeError, match="queue_full"):
        slow.submit()
    slow.close()


def test_phases_resume(spark, tmp_path):
    made = []

    def phase(name, fail=False):
        def make(spark, done):
            made.append(name)
            if fail:
                raise OSError("lost")
            return spark.range(len(done) + 1)

        return name, make

    with pytest.raises(OSError):
        work.run_phases(spark, str(tmp_path), [phase("a"), phase("b", True)])
    assert work.finished_phases(spark, str(tmp_path), ["a", "b"]) == ["a"]
    assert work.run_phases(spark, str(tmp_path), [phase("a"), phase("b")])["b"].count() == 2 and made == ["a", "b", "b"]


def test_backups_and_checkpoints(spark, tmp_path):
    path = str(tmp_path / "state")
    assert readers.crawl_checkpoint(spark, path) is None
    state = spark.createDataFrame([("http://h", "irk")], "base_url string, city_slug string")
    sinks.json_backup(state, path)
    sinks.json_backup(state.withColumn("city_slug", F.lit("msk")), path)
    assert [r["city_slug"] for r in readers.crawl_checkpoint(spark, path).collect()] == ["msk"]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["state"]
    (tmp_path / "broken.json").write_text("{oops")
    assert readers.crawl_checkpoint(spark, str(tmp_path / "broken.json")) is None
    sinks.experiment(spark, str(tmp_path / "log"), {"k": 5}, {"confidence": 0.5})
    sinks.experiment(spark, str(tmp_path / "log"), {"k": 6}, {"confidence": 0.6})
    assert {r["params"]["k"] for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {"5", "6"}


def test_a_poller_starts_once_and_tells_its_state(spark, tmp_path):
    schema = "id long, day string"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema).write.parquet(str(tmp_path / "in"))
    poller = jobs.Poller(lambda: jobs.poll(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "c"), ["id"], "1 second", "day"))
    assert poller.status() == {"running": False, "batches": 0, "error": None} and not poller.stop()
    assert poller.start() and not poller.start()
    poller.query.processAllAvailable()
    spark.createDataFrame([(2, "b"), (3, "b")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    poller.query.processAllAvailable()
    assert poller.status()["running"] and poller.status()["batches"] >= 2 and poller.stop() and not poller.status()["running"]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_sessions_keep_the_last_turns(spark, tmp_path):
    schema = "session_id long, ts long, role string, said string, entity string"
    turns = [(1, 2 * i + k, role, f"{said}{i}", "A" if i == 1 and k else None) for i in range(5) for k, (role, said) in enumerate((("user", "q"), ("bot", "a")))]
    for part, rows in enumerate((turns[6:], turns[:6])):  # the later turns come first
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    (row,) = jobs.run_to_table(spark, jobs.sessions(stream, expire=False, limit=2), ["session_id"]).collect()
    assert (row["kept"], row["history"], row["entity"]) == (4, ["q3", "a3", "q4", "a4"], "A")


def test_salvage_and_payload(spark):
    broken = '{"rating": 3 "sentiment": "neg", "summary": "a\\nb \\"c\\" ", "tags": ["x", "y"], oops'
    found = one(spark, T.salvaged(F.lit(broken)))
    assert (found["rating"], found["sentiment"], found["tags"]) == (3, "neg", ["x", "y"]) and found["summary"].startswith("a\nb")
    assert one(spark, T.salvaged(F.lit('"summary": "cut off here'))) ["summary"] == "cut off here"
    assert one(spark, T.salvaged(F.lit("prose"))) is None and one(spark, T.salvaged(F.lit(None).cast("string"))) is None
    at = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("at")
    assert json.loads(one(spark, T.payload(at, F.lit(None).cast("int").alias("n"), F.array(F.lit(1)).alias("l")))) == {"at": "2024-01-02T03:04:05", "n": None, "l": [1]}
    answers = spark.createDataFrame([('x {"rating": 9, "tags": ["a"]} y',), (broken,), ("nothing",)], "answer string")
    assert [(r["ai_rating"], r["tags"]) for r in ingest.analysed(answers, "answer").collect()] == [(5, "a"), (3, "x, y"), (4, "")]


REVIEWS = "review_id long, entity_id string, entity_name string, text string, rating double, answered boolean, created string, doctor_id int, doctor_name string, pos int"


def sample(spark):
    rows = [
        (1, "a", "Альфа", "Очередь два часа, долго ждал", 4.0, False, "2024-01-01", 1, "D", 1),
        (2, "a", "Альфа", "Врач подробно объяснил, компетентный", 10.0, False, "2024-01-02", 1, "D", 2),
        (3, "a", "Альфа", "Дорого и долгое ожидание", 5.0, False, "2024-01-03", 2, "E", 3),
        (4, "a", "Альфа", "Быстро, рядом с домом", 9.0, True, "2024-01-04", 2, "E", 4),
        (5, "b", "Бета", "Очередь, ждал", 3.0, True, "2024-01-04", 3, "F", 5),
        (6, "b", "Бета", "Чисто и уютно", 9.0, True, "2024-01-04", 3, "F", 6),
        (7, "c", "Гамма", "", None, True, None, None, None, 7),
    ]
    return spark.createDataFrame(rows, REVIEWS)


def test_report_by_rule(spark):
    rows = {r["entity_id"]: r for r in heuristics.report(sample(spark), ["entity_id"], "entity_name", "text").collect()}
    a, c = rows["a"], rows["c"]
    assert a["top_complaints"][0] == "долгое ожидание и очереди" and "понятные объяснения врача" in a["what_patients_value"]
    assert a["executive_summary"].startswith("«Альфа»: 4 отзывов в выборке. Средняя оценка 7.0. Доля негатива 50.0%. Без ответа клиники 75.0%. Чаще всего ценят: ")
    assert a["service_improvements"][:3] == [heuristics.ANSWER_MORE, heuristics.SET_STANDARDS, heuristics.IMPROVEMENTS["долгое ожидание и очереди"]]
    assert a["landing_page_gaps"] == [*heuristics.ALWAYS_ON_PAGE, heuristics.LANDING["долгое ожидание и очереди"], heuristics.LANDING["высокая цена"]]
    assert "компетентность врача" in a["target_audience"] and a["ad_angle"].startswith("Акцент для рекламы: ") and a["risk_topics"][0] == "долгое ожидание и очереди"
    assert c["what_patients_value"] == [heuristics.NO_PRAISE] and c["top_complaints"] == [heuristics.NO_COMPLAINTS] and c["risk_topics"] == [heuristics.NO_RISKS]
    assert c["executive_summary"] == f"«Гамма»: 1 отзывов в выборке. Без ответа клиники 0.0%. {heuristics.MADE_BY_RULE}" and c["service_improvements"] == [heuristics.NO_ADVICE]
    assert c["target_audience"] == "Пациенты, которым важны качество приёма и предсказуемость сервиса."
    assert heuristics.report(sample(spark).where("pos > 99"), ["entity_id"], "entity_name", "text").count() == 0


def test_comparison_by_rule(spark):
    each, whole = heuristics.compare(sample(spark), ["b", "a"], "entity_name", "text")
    rows, row = each.collect(), whole.first()
    assert [r["entity_id"] for r in rows] == ["b", "a"] and rows[0]["strengths"] == ["чистота и комфорт в клинике"] == rows[0]["unique_selling_points"]
    assert row["shared_complaints"] == ["долгое ожидание и очереди"] and row["winner_by_metric"].asDict() == {"avg_rating": "Альфа", "answered_pct": "Бета", "review_count": "Альфа"}
    assert row["summary"].startswith("«Бета»: 2 отз., рейтинг 6.0, негатив 50.0%, ответы 100.0%. «Альфа»: 4 отз.") and "лучший рейтинг — «Альфа»" in row["summary"]
    assert row["ad_angle"].startswith("«Бета» — акцент на чистота и комфорт в клинике; «Альфа» — акцент на ")
    _, none = heuristics.compare(sample(spark), ["c", "b"], "entity_name", "text")
    assert none.first()["shared_complaints"] == [heuristics.NOTHING_SHARED] and none.first()["winner_by_metric"]["avg_rating"] == "Бета"


def test_winners_are_told_by_unrounded_metrics(spark):
    rows = [(i, "ab"[i % 2], "АБ"[i % 2], "", 5.5 if i == 1 else 5.0, i != 0, "2024-01-01", 1, "D", i) for i in range(4000)]
    own = spark.createDataFrame(rows, REVIEWS)
    assert {r["avg_rating"] for r in M.entity_metrics(own, ["entity_id"]).collect()} == {5.0}
    whole = heuristics.compare(own, ["a", "b"], "entity_name", "text")[1].first()
    assert whole["winner_by_metric"].asDict() == {"avg_rating": "Б", "answered_pct": "Б", "review_count": "А"} and "лучший рейтинг — «А»" in whole["summary"]
    assert tuple(R.winners(M.compared_by(own, ["entity_id"]).withColumn("position", F.ascii("entity_id"))).first()) == ("b", "b", "a")


def test_confidence(spark):
    chunks = spark.createDataFrame([("the answer is here",), ("",)], "text string")
    row = M.confidence(chunks, "text", "the answer").first()
    assert (row["confidence"], row["passed"], row["notes"]) == (0.6, True, "ok")
    none = M.confidence(chunks.where("text = 'x'"), "text", "the answer").first()
    assert (none["confidence"], none["passed"], none["notes"]) == (0.12, False, "no_relevant_chunks")  # 0.125 is a tie, and goes to the even digit


@pytest.mark.parametrize("early", [0, 10_000])
def test_pages_of_a_sort(spark, monkeypatch, early):
    monkeypatch.setattr(S, "EARLY", early)
    df = spark.range(103).selectExpr("id", "id % 7 as k")
    order = [F.col("k"), F.col("id").desc()]
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    for number, at in ((0, 0), (1, 0), (2, 10), (11, 100), (99, 100)):
        page = S.page(df, number, 10, order)
        assert [r["id"] for r in page.collect()] == whole[at : at + 10] and page.columns == ["id", "k"]
    assert S.page(df.where("id < 0"), 3, 10, order).count() == 0


def test_many_needles_find_what_few_do(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abñ ") for _ in range(rng.randint(0, n)))
    names = [(str(i), word(14), i) for i in range(150)] + [("x", None, 0), ("y", "a" * 300, 1)]
    needles = [(w,) for w in {word(6) for _ in range(200)}] + [("a" * 200,), ("zzz",), (None,), ("ab",), ("ab",), ("AB!",)]
    df, wanted = spark.createDataFrame(names, "entity_id string, entity_name string, pos int"), spark.createDataFrame(needles, "needle string")
    few = sorted(map(str, E.match_needles(df, wanted).collect()))
    monkeypatch.setattr(E, "MOST_NEEDLES", 10)
    many = E.match_needles(df, wanted)
    assert sorted(map(str, many.collect())) == few and len(few) > 500
    assert "NestedLoop" not in many._jdf.queryExecution().executedPlan().toString()


def test_flags(spark):
    df = spark.createDataFrame([(1, True, False), (2, None, False), (3, True, None), (4, False, True)], "id int, a boolean, b boolean")
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(S.where_true(df, "a")) == [1, 3] and ids(S.where_false(df, "b")) == [1, 2] and ids(S.where_present(df, "a", "b")) == [1, 4]


def test_page_kinds_have_their_readers(spark):
    state = {"props": {"pageProps": {"preloadedState": {"servicePage": {"serviceInfo": {"id": 5, "name": "S"}}}}}}
    html = f'<script id="__NEXT_DATA__">{json.dumps(state)}</script><a href="/service/d/u">x</a>'
    rows = [(f"https://irk.example.com{path}", html) for path in ("/", "/service/d/u", "/clinic/c", "/doctor/d", "/other")]
    found = pages.parsed(spark.createDataFrame(rows, "page_url string, html string"))
    assert {k: df.count() for k, df in found.items()} == dict.fromkeys(("main", "service", "clinic", "doctor", "unknown"), 1)
    assert found["main"].first()["service_urls"] == ["/service/d/u"] and found["service"].first()["info"]["id"] == 5
    services, hubs = one(spark, F.struct(*T.service_links(F.lit('<a href="/service/b/c"><a href="/service/z"><a href="/service/a">'))))
    assert services == ["/service/b/c"] and hubs == ["/service/a", "/service/z"]


def test_reviews_of_a_page_and_its_review_pages(spark):
    rows = lambda *r: spark.createDataFrame(r, "review_id long, text string, created string, pos int")
    merged = pages.merged_reviews(rows((1, "old", "d", 0), (None, "t", "d", 1)), rows((2, "new", "d", 0), (1, "newer", "d", 1), (None, "t", "d", 2))).orderBy("pos").collect()
    assert [(r["review_id"], r["text"]) for r in merged] == [(1, "newer"), (None, "t"), (2, "new")]


def test_api_answers(spark):
    bodies = [json.dumps({"rows": [{"id": 1}], "total": 9}), json.dumps({"reviews": [], "totalCount": 3}), json.dumps({"error": "no"}), "oops"]
    read = readers.review_payload(spark.createDataFrame([(b,) for b in bodies], "body string"), "body").collect()
    assert [(None if r["rows"] is None else len(r["rows"]), r["total"], r["error"]) for r in read] == [(1, 9, None), (0, 3, None), (None, None, "no"), (None, None, None)]
    raw = {"id": 7, "text": "t", "answer": "a", "created": "2024-01-01", "ratingClinic": 4.5, "publicName": "N", "clinic": {"name": "C", "alias": "c", "fullAddress": {"city": "Иркутск"}}, "rating": {"label": "good", "value": 9}, "doctor": {"id": 0, "name": "D"}}
    row = readers.canonical_api_review(spark.createDataFrame([(json.dumps(raw),)], "body string"), "body").first()
    assert len(row) == 18 and (row["review_id"], row["clinic_city"], row["rating_value"], row["rating_clinic"], row["doctor_id"], row["doctor_name"]) == (7, "Иркутск", 9.0, 4.5, None, "D")
    prices = spark.createDataFrame([(json.dumps({"x": {"title": "X", "prices": [{"name": "p", "price": 5}]}, "y": {"prices": []}}),)], "body string")
    assert [tuple(r)[1:] for r in readers.price_list(prices, "body").collect()] == [("X", "p", 5.0)]
    assert one(spark, T.attribute_json(F.lit("<x-y :clinics='[{&quot;id&quot;: 1}]'>"), "clinics")) == '[{"id": 1}]'


def test_runs_snippets_and_flags(spark, tmp_path):
    run = spark.createDataFrame([(1, "p")], "id int, product_name string")
    for _ in range(2):
        tools.persist_run(run, spark.createDataFrame([(1, "e"), (1, "f")], "run_id int, name string"), str(tmp_path / "r"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2 and spark.read.parquet(str(tmp_path / "e")).count() == 4
    chunk = lambda *r: spark.createDataFrame(r, "chunk_id int, title string, text string, pos int")
    merged = R.snippets_merged(chunk((1, "t", "neg", 0), (None, "t", "x", 1)), chunk((1, "t", "gen", 0), (2, "t", "y", 1), (None, "t", "x", 2)))
    assert sorted((r["chunk_id"] or 0, r["text"]) for r in merged.collect()) == [(0, "x"), (1, "neg"), (2, "y")]
    assert [one(spark, routing.is_incomplete(F.lit(a), F.lit(b).cast("int"))) for a, b in ((1, 2), (2, 2), (1, None))] == [True, False, False]
    text = R.report_text({"avg_rating": 4.25, "review_count": 3, "unanswered_pct": 50.0, "complaints": ["x"], "praises": None})
    assert text == "3 reviews with a mean rating of 4.2; 50.0 % without an answer. Most frequent complaints: x."
    sinks.json_rows(run, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["product_name"] == "p"


def test_exports_by_line_and_in_streams(spark, tmp_path):
    message = {"type": "message", "id": 1, "date": "2024-01-01T10:00:00", "from": "F", "text": "hi", "reply_to_message_id": 7}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps({"id": 5, "name": "N", "type": "t", "messages": [message, {"type": "service", "id": 2}]}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(message | {"id": i}) for i in range(3)))
    assert readers.chat_messages(spark, str(tmp_path / "a")).count() == 1
    assert [r["message_id"] for r in readers.message_lines(spark, str(tmp_path / "lines.json"), "5").collect()] == [0, 1, 2]
    (meta,) = readers.chat_meta(spark, str(tmp_path / "a")).collect()
    assert tuple(meta) == (5, "N", "t", "5")
    assert jobs.run_to_table(spark, readers.chat_stream(spark, str(tmp_path / "a"))).first()["text"] == "hi"


def test_a_cluster_must_name_its_shared_folder(spark):
    assert storage.shared_dir(spark)

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
