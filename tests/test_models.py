"""Models that the caller brings, the chart, the command line, reports in other words and answers."""

import json
import struct
import zlib

import duckdb
from pyspark.sql import functions as F

from opinara import queries
from opinara.__main__ import main
from opinara.functions import routing
from opinara.plans import heuristics, models, research
from opinara.plans.tools import Tools
from opinara.sources import sinks


def test_a_model_that_fails_leaves_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "b")], "id int, text string").coalesce(1)

    def ask(texts):
        if "bad" in texts:
            raise ValueError("down")
        return [t * 2 for t in texts]

    rows = {r["id"]: r["answer"] for r in models.answered(df, "text", ask, batch=2).collect()}
    assert rows == {1: "aa", 2: None, 3: None, 4: None}
    assert models.answered(df.where("id < 0"), "text", ask).count() == 0
    vectors = {r["id"]: r["embedding"] for r in models.embedded(df.withColumn("text", F.coalesce("text", F.lit(" "))), "text", lambda texts: [[len(t)] * 3 for t in texts], 2).collect()}
    assert vectors == {1: [1.0, 1.0], 2: None, 3: [3.0, 3.0], 4: [1.0, 1.0]}


def test_the_model_in_capitals_writes_as_sql_does(spark, tmp_path):
    texts = ["ß ist", "ﬁnal", "ᾳŉǰ", "ǆΐé", None, "", "straße"]
    rows = [(4 * i + i // 6 * 3, t, "src") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["answer"] for r in queries.injected_models(spark, str(tmp_path)).collect()}
    held = duckdb.sql(f"WITH documents AS (SELECT * FROM '{tmp_path}/documents.parquet/*.parquet') {queries.ORACLE_SQL['injected_models']}").fetchall()
    assert got[0] == "ẞ IST" and {k: v for k, v, *_ in held} == got
    every = "".join(map(chr, range(1, 0x110000))).encode("utf-8", "ignore").decode()
    assert queries._upper(every) == duckdb.execute("SELECT upper(?)", [every]).fetchone()[0]


def test_chart(spark):
    series = spark.createDataFrame([("2024-01-01", 3, 0.5), ("2024-01-02", 9, None), ("2024-01-03", 1, 0.7), ("2024-01-04", 2, 0.9)], "date string, runs long, avg_confidence double")
    png = sinks.chart_png(series, 60, 20)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (60, 20)
    at = png.index(b"IDAT")
    raw = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert len(raw) == 20 * (1 + 60 * 3) and bytes((31, 119, 180)) in raw and bytes((255, 127, 14)) in raw
    assert sinks.chart_png(series.where("runs > 99"), 10, 10)[:4] == b"\x89PNG"


def test_command_line(spark, tmp_path, capsys):
    message = {"type": "message", "id": 1, "date": "2024-01-01T10:00:00", "from": "F", "text": "hi"}
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"id": 5, "name": "N", "messages": [message, message | {"id": 2, "date": "2023-05-01T10:00:00", "reply_to_message_id": 1}]}))
    assert main(["scan", str(path)]) == 0 and "|2    |2        |0         |1      |" in capsys.readouterr().out
    assert main(["parse", str(path), str(tmp_path / "out")]) == 0 and spark.read.json(str(tmp_path / "out")).count() == 2
    assert main(["years", str(path), str(tmp_path / "y"), "2023"]) == 0 and spark.read.json(str(tmp_path / "y")).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"services": [{"ok": True, "service": {"id": 1, "name": "S"}, "reviews": [{"review_id": 1, "text": "t"}]}]}))
    assert main(["crawl", str(tmp_path / "c.json")]) == 0 and "inserted" in capsys.readouterr().out


def test_reports_in_other_words():
    made = heuristics.normalised({"Report": {"Сводка": " s ", "плюсы": "- a\n• b\n\n", "risks": [" r ", ""], "audience": None}})
    assert made == {
        "executive_summary": "s", "what_patients_value": ["a", "b"], "top_complaints": [], "service_improvements": [], "landing_page_gaps": [],
        "ad_angle": "", "target_audience": "", "risk_topics": ["r"],
    }
    assert heuristics.normalised("no")["top_complaints"] == [] and heuristics.normalised({"summary": "x", "data": {"other": 1}})["executive_summary"] == "x"


def test_answers():
    text = heuristics.report_answer("А", {"review_count": 2, "avg_rating": 7.0, "negative_pct": 50.0, "unanswered_pct": 0.0}, {"executive_summary": "S", "top_complaints": ["x", "y"], "ad_angle": "z"})
    assert text == "**А** — отзывов: 2, avg: 7.0, негатив: 50.0%, без ответа: 0.0%\n\nS\n\n**Жалобы:** x; y\n\n**Угол для рекламы:** z"
    text = heuristics.comparison_answer({"summary": "S", "shared_complaints": ["c"], "ad_angle": "a"}, [{"entity_name": "A", "strengths": ["s"], "weaknesses": []}])
    assert text == "S\n\n**A**\nсильные: s\n\n**Общие жалобы:** c\n\n**Кому какой угол:** a"
    assert "ничего не нашлось" in heuristics.search_answer("q", [])
    found = heuristics.search_answer("q", [{"title": None, "chunk_id": 3, "snippet": "x" * 300}] * 7)
    assert found.count("\n") == 5 and "**3** — " + "x" * 240 + "…" in found


def test_a_detector_of_the_caller_decides(spark):
    tools = Tools()
    tools.register("rag_search", lambda **given: "found", "chat")
    detect = lambda q: routing.intent(F.lit("покажи отзывы «Гамма»"))
    assert research.chat(spark, "привет", tools, detect=detect)["intent"]["entities"] == ["Гамма"]
