"""Sessions in a stream: what a turn takes over from turns of earlier batches, and what it doesn't after a session's end."""

import itertools
import time

from pyspark.sql import functions as F

from opinara.functions import routing
from opinara.streaming import jobs

SCHEMA = "session_id long, ts long, role string, said string"


def run(spark, tmp_path, batches, wait=0, **options):
    """The answers to each batch, which comes as the earlier ones are done."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    found = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.dialogues(spark.readStream.schema(SCHEMA).parquet(source), **options)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        for _ in range(300):  # a query whose state expires by the clock goes on without rows, so it is stopped when its rows are done
            if sum(p["numInputRows"] for p in query.recentProgress) >= len(rows):
                break
            time.sleep(0.2)
        query.stop()
        found.append({(r["session_id"], r["ts"]): tuple(r)[2:] for r in spark.read.parquet(out).collect()})
        time.sleep(wait)
    return [{k: v for k, v in now.items() if k not in before} for before, now in itertools.pairwise([{}, *found])]


def test_turns_take_over_what_earlier_batches_asked(spark, tmp_path):
    first = [(1, 10, "user", "проанализируй клинику «Alpha»"), (1, 11, "bot", "готово"), (2, 10, "user", "ясно"), (3, 10, "user", None), (None, 5, "user", "ясно")]
    second = [(1, 21, "user", "то же самое"), (1, 20, "user", "ясно"), (2, 20, "user", "а теперь «Beta»"), (1, 22, "user", "и по клинике «Beta»")]
    one, two = run(spark, tmp_path, [first, second], expire=False)
    assert one == {
        (1, 10): ("reputation_analyze", "clinic", ["Alpha"], 0.75, 1), (2, 10): ("fallback", None, [], 0.2, 1), (3, 10): ("fallback", None, [], 0.2, 1),
        (None, 5): ("fallback", None, [], 0.2, 1),
    }
    assert two == {
        (1, 20): ("fallback", "clinic", ["Alpha"], 0.2, 3), (1, 21): ("reputation_analyze", "clinic", [], 0.7, 4), (1, 22): ("reputation_analyze", "clinic", ["Beta"], 0.7, 5),
        (2, 20): ("fallback", None, ["Beta"], 0.2, 2),
    }


def test_sessions_end_by_the_clock_and_by_their_turns(spark, tmp_path):
    asks, goes_on = "проанализируй клинику «Alpha»", "то же самое"
    batches = [[(1, 10, "user", asks), (2, 10, "user", asks), (2, 14, "user", goes_on)], [(1, 12, "user", goes_on)]]
    one, two = run(spark, tmp_path, batches, wait=5, ttl=3)
    assert one[1, 10][0] == one[2, 10][0] == "reputation_analyze" and one[2, 14] == ("fallback", None, [], 0.2, 1)  # 4 seconds later
    assert two == {(1, 12): ("fallback", None, [], 0.2, 1)}  # its own time says 2 seconds, the clock 5


def test_history_is_cut(spark, tmp_path):
    turns = [(1, i, "user" if i % 2 == 0 else "bot", "ясно") for i in range(9)]
    one, two = run(spark, tmp_path, [turns, [(1, 9, "user", "ясно")]], expire=False, limit=2)
    assert [one[1, i][4] for i in (0, 2, 4, 6, 8)] == [1, 3, 4, 4, 4] and two[1, 9][4] == 4


def test_the_state_fills_in_as_the_columns_do(spark):
    said = ["проанализируй клинику «Alpha»", "проанализируй отзывы", "покажи отзывы", "покажи отзывы «Beta»", "ясно", "то же самое", "а теперь «Gamma»", "тогда покажи отзывы «Beta»", "и по врачу Иванов"]
    last = [(i, k, e) for i in (None, "rag_search", "reputation_analyze") for k in (None, "clinic") for e in ([], ["Old"])]
    rows = spark.createDataFrame([(q, l) for q in said for l in last], "q string, last struct<intent string, entity_kind string, entities array<string>>")
    q = F.col("q")
    rows = rows.select("last", routing.intent(q).alias("asked"), routing.is_continued(q).alias("more"), routing.named_late(q).alias("late"), routing.in_session(q, routing.intent(q), F.col("last")).alias("want"))
    for r in rows.collect():
        assert jobs.inherited(r["asked"], r["more"], r["late"], tuple(r["last"])) == tuple(r["want"])
