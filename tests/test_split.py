"""One JSON document read in parts: the same messages whatever the cuts."""

import json

import pytest

from opinara.sources import readers, split

TRICKY = {
    "name": "a {b} \"c\" \\",
    "meta": {"x": {"y": [1, {"z": "}"}]}, "messages": [{"id": 99}]},
    "messages_count": 3,
    "list": [{"id": 98}, {"messages": [{"id": 97}]}],
    "messages": [
        {"id": 1, "type": "message", "text": "one } two { \" \\", "date": "2024-01-01T00:00:00"},
        7, "}{", [{"id": 96}, []], {},
        {"id": 2, "type": "message", "text": ["a", {"type": "bold", "text": "b}"}, "c"], "poll": {"question": "q?", "answers": [{"text": "y"}, {"text": "n"}]}},
        {"id": 3, "type": "service", "text": ""},
        {"id": 4, "type": "message", "text": "\\\\\"}, {", "reply_to_message_id": 1},
    ],
    "id": "12",
    "after": [{"id": 95}],
    "last": {"messages": {"id": 94}},
}


def found(spark, path):
    rows, fields = split.elements(spark, str(path), "messages")
    got = {r["file"]: [] for r in rows.select("file").distinct().collect()}
    for r in rows.orderBy("file", "number").collect():
        got[r["file"]].append(json.loads(r["element"]))
    return list(got.values()), {(r["key"], r["value"]) for r in fields.collect()}


SHORT = {"name": "}{\"", "messages": [{"i": "\\}"}, [{}], {"a": [{}, 1]}], "z": 0}


@pytest.mark.parametrize("doc, size, indent, chunk", [(SHORT, 3, None, 2), (TRICKY, 16, 1, 2), (TRICKY, 64, None, 1 << 15), (TRICKY, 1 << 20, 2, 5)])
def test_elements_are_the_documents(spark, tmp_path, monkeypatch, doc, size, indent, chunk):
    """Cuts of some bytes, in strings, escapes and brackets too."""
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=indent) + ("\n" if indent else ""))
    monkeypatch.setattr(split, "CHUNK", chunk)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lists, fields = found(spark, tmp_path / "a.json")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert lists == [[m for m in doc["messages"] if isinstance(m, dict)]]
    assert fields == {(json.dumps(k), json.dumps(v)) for k, v in doc.items() if not isinstance(v, (dict, list))}


def test_messages_are_those_of_the_whole_reader(spark, tmp_path):
    for i in range(3):
        doc = {k: v for k, v in TRICKY.items() if k != "id"} | ({"id": i} if i else {}) | {"messages": [m for m in TRICKY["messages"] if isinstance(m, dict) and m]}
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=i or None))
    whole, parts = readers.chat_messages(spark, str(tmp_path)), readers.split_chat_messages(spark, str(tmp_path))
    assert parts.columns == whole.columns
    key = lambda r: (r["export_key"], r["message_id"])
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str) and len({key(r) for r in parts.collect()}) == 9


def test_cut_off_empty_and_other_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"messages": [{"id": 1}, {"id": 2, "x": {"y": 1')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text('{"messages": []}')
    (tmp_path / "d.json").write_text('{"other": [{"id": 1}]}')
    assert found(spark, tmp_path)[0] == [[{"id": 1}]]
