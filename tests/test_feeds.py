"""Paged feeds read in batch and in a stream."""

import inspect
import json

from opinara import queries
from opinara.sources.feeds import paged_feeds


def fetch(folder):
    def of(feed, offset):
        with open(f"{folder}/{feed}.json") as f:
            rows = json.load(f)
        if feed == "down" and offset >= 5:
            return [], None, "no answer"
        return rows[offset : offset + (8 if feed == "long pages" else 5)], len(rows) if feed == "told" else None, None

    return of


def fill(folder, feeds):
    for name, rows in feeds.items():
        (folder / f"{name}.json").write_text(json.dumps(rows))


def sizes(folder):
    def now():
        import pathlib

        return {p.stem: None if p.stem == "unknown" else len(json.loads(p.read_text())) for p in pathlib.Path(folder).glob("*.json")}

    return now


FEEDS = {
    "plain": list(range(13)), "told": [{"a": "é"}] * 10, "empty": [], "down": list(range(20)), "blank": [1] * 5 + [None] * 10 + [2] * 5, "holes": [1, None, 2, 3, 4, 5, None],
    "long pages": list(range(18)), "unknown": [1, 2],
}


def test_a_batch_drains_each_feed(spark, tmp_path):
    fill(tmp_path, FEEDS)
    spark.dataSource.register(paged_feeds("batch_feeds", fetch(str(tmp_path)), sizes(str(tmp_path)), size=5))
    df = spark.read.format("batch_feeds").load()
    assert df.rdd.getNumPartitions() == len(FEEDS)
    found = {}
    for r in df.orderBy("feed", "place").collect():
        found.setdefault(r["feed"], []).append((r["place"], json.loads(r["row"])))
    whole = {name: [(i, row) for i, row in enumerate(rows) if row is not None] for name, rows in FEEDS.items()}
    assert found == {k: v for k, v in whole.items() if v} | {"down": whole["down"][:5], "blank": whole["blank"][:5]}
    spark.dataSource.register(paged_feeds("few_pages", fetch(str(tmp_path)), sizes(str(tmp_path)), size=5, most=2))
    assert spark.read.format("few_pages").load().where("feed = 'plain'").count() == 10


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    feeds = tmp_path / "feeds"
    feeds.mkdir()
    spark.dataSource.register(paged_feeds("stream_feeds", fetch(str(feeds)), sizes(str(feeds)), size=5))

    def run():
        query = spark.readStream.format("stream_feeds").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return sorted((r["feed"], r["place"], json.loads(r["row"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    fill(feeds, {"a": list(range(7)), "b": [9, None], "unknown": [1]})
    assert run() == [("a", i, i) for i in range(7)] + [("b", 0, 9)]
    fill(feeds, {"a": list(range(16)), "c": [5]})
    assert run() == [("a", i, i) for i in range(16)] + [("b", 0, 9), ("c", 0, 5)]


def test_events_are_served_part_by_part(spark, monkeypatch):
    """What asks for a page holds one part of a feed, not the table; a page may begin in one part and end in the next."""
    sf, asked = "/root/testdata/sf0.001", []
    monkeypatch.setattr(queries, "FED_PAGE", 7, raising=False)
    monkeypatch.setattr(queries, "FED_PAGES", 2, raising=False)
    monkeypatch.setattr(queries.feeds, "paged_feeds", lambda name, fetch, *more: asked.append(fetch) or paged_feeds(name, fetch, *more))
    rows = {}
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").collect()):
        rows.setdefault(f"users-{r['user_id'] % 8}", []).append({"event_id": r["event_id"], "value": r["value"]})
    got = sorted((r["feed"], r["place"], r["event_id"]) for r in queries.paged_feed(spark, sf).collect())
    assert got == sorted((feed, i, r["event_id"]) for feed, own in rows.items() for i, r in enumerate(own))
    fetch, feed = asked[0], max(rows, key=lambda f: len(rows[f]))
    assert [fetch(feed, at)[0] for at in (0, 10, len(rows[feed]) - 2, len(rows[feed]))] == [rows[feed][:7], rows[feed][10:17], rows[feed][-2:], []]
    stored = inspect.getclosurevars(fetch).nonlocals["stored"]
    assert sum(map(len, inspect.getclosurevars(stored).nonlocals["held"].values())) <= 14


def test_a_stream_of_events_is_served_part_by_part(spark, monkeypatch):
    sf, asked = "/root/testdata/sf0.001", []
    monkeypatch.setattr(queries, "FED_PAGE", 7, raising=False)
    monkeypatch.setattr(queries, "FED_PAGES", 2, raising=False)
    monkeypatch.setattr(queries.feeds, "paged_feeds", lambda name, fetch, *more: asked.append(fetch) or paged_feeds(name, fetch, *more))
    found = sorted(map(tuple, queries.paged_feed_stream(spark, sf).collect()))
    assert found == sorted(map(tuple, queries.paged_feed(spark, sf).collect())) and len(found) == spark.read.parquet(f"{sf}/events.parquet").count()
    for number in range(3):
        assert len(asked[0]("users-0", 14 * number)[0]) == 7
        stored = inspect.getclosurevars(asked[0]).nonlocals["stored"]
        assert list(inspect.getclosurevars(stored).nonlocals["held"]) == [("users-0", number)]
