import json
import random

import pytest

from mnemolith.sources.chat_exports import blank_dropped, conversation_records, read_deepseek, read_grok, read_openai, select_reader
from mnemolith.sources.json_records import json_records


def node(text, **more):
    return {"message": {"id": more.pop("id", None), "content": {"parts": text if isinstance(text, list) else [text]}, **more}}


@pytest.fixture()
def openai_file(tmp_path):
    talks = [
        {
            "id": "c1",
            "title": "",
            "create_time": 1700000000,
            "mapping": {
                "n9": {"message": None},
                "n1": {"message": {"id": "m1", "content": None}},
                "n2": node(["hi", {"img": 1}, "yo", 3], id="m2", author={"role": "tool"}, metadata={"model_slug": None}),
                "n0": node("   ", id="m3", author={"role": "system"}, metadata={}),
                "n3": node([], id="m4"),
                "n4": node("bye", author={"role": "assistant"}, metadata={"model_slug": "m-2"}, create_time="2026-03-18T08:31:00"),
            },
        },
        {"conversation_id": "c2", "title": "T", "mapping": {"a": node("x")}},
        {"mapping": {"b": node("y")}},
    ]
    path = tmp_path / "chat.json"
    path.write_text(json.dumps(talks))
    return str(path)


def test_openai(spark, openai_file):
    rows = {r.message_id: r for r in read_openai(spark, openai_file).collect()}
    assert set(rows) == {"m2", "m3", "n4", "a", "b"}
    assert (rows["m2"].content, rows["m2"].sender_type, rows["m2"].model, rows["m2"].sequence) == ("hiyo", "user", "None", 0)
    assert (rows["m3"].sender_type, rows["m3"].model, rows["m3"].sequence) == ("system", "unknown", 1)
    assert (rows["n4"].sender_type, rows["n4"].model, rows["n4"].sequence, rows["n4"].timestamp) == ("assistant", "m-2", 2, "2026-03-18 08:31:00")
    assert rows["m2"].title == "Untitled conversation" and rows["m2"].conversation_created_at == "2023-11-14 22:13:20"
    assert rows["a"].conversation_id == "c2" and rows["b"].conversation_id == "None"
    kept = blank_dropped(read_openai(spark, openai_file))
    assert {(r.message_id, r.sequence) for r in kept.collect()} == {("m2", 0), ("n4", 2), ("a", 0), ("b", 0)}
    assert {r.conversation_id for r in conversation_records(spark, openai_file).collect()} == {"c1", "c2", "None"}


def test_grok(spark, tmp_path):
    talks = {
        "conversations": [
            {
                "conversation": {"id": "g1", "title": "G", "create_time": "2026-03-18T08:30:00Z"},
                "responses": [
                    {"response": {"_id": "r1", "message": "", "sender": "human"}},
                    {"response": {"_id": "r2", "message": "a", "sender": "ASSISTANT", "create_time": {"$date": {"$numberLong": "1700000000123"}}}},
                    {"response": {"message": "b", "sender": "robot", "model_slug": "g-1"}},
                    {"response": {"_id": "r4", "message": "c", "sender": "human"}},
                ],
            }
        ]
    }
    path = tmp_path / "grok.json"
    path.write_text(json.dumps(talks))
    rows = {r.message_id: r for r in read_grok(spark, str(path)).collect()}
    assert {k: (r.sender_type, r.sequence, r.model) for k, r in rows.items()} == {"r2": ("assistant", 1, "unknown"), "None": ("assistant", 2, "g-1"), "r4": ("user", 3, "unknown")}
    assert rows["r2"].timestamp == "2023-11-14 22:13:20" and rows["r2"].conversation_created_at == "2026-03-18 08:30:00"


def test_reader_choice():
    assert select_reader("/data/GROK/deepseek.json") is read_grok
    assert select_reader("/data/DeepSeek.json") is read_deepseek
    assert select_reader("/data/chat.json") is read_openai


def _strange(chance, deep):
    pieces = ["a", "{", "}", "[", "]", '"', "\\", "\n", "é", "漢", " ", '\\\\"', "{{", '"}', ":,"]
    kind = chance.random()
    if not deep or kind < 0.4:
        return "".join(chance.choice(pieces) for _ in range(chance.randrange(50)))
    if kind < 0.6:
        return chance.choice([1, 2.5, None, True])
    if kind < 0.8:
        return [_strange(chance, deep - 1) for _ in range(chance.randrange(4))]
    return {f"k{k}": _strange(chance, deep - 1) for k in range(chance.randrange(4))}


@pytest.mark.parametrize("form", ["array", "indented", "object", "nested", "empty"])
def test_records_by_ranges(spark, tmp_path, form):
    """Ranges that cut strings, escapes and records give what the whole document holds."""
    chance = random.Random(form)
    records = [{"id": i, "v": _strange(chance, 3), "long": _strange(chance, 0) * (60 if i % 7 == 0 else 1)} for i in range(40)]
    body = {"array": records, "indented": records, "object": {"id": 9, "all": records}, "nested": {"a": 1, "conversations": records, "z": ["{"]}, "empty": []}[form]
    expected = [body] if form == "object" else [] if form == "empty" else records
    path = tmp_path / "an export é.json"
    path.write_text(json.dumps(body, ensure_ascii=form == "array", indent=1 if form == "indented" else None))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for size in (900, 10**8):
            for n, value in zip(names, (size, 1)):
                spark.conf.set(n, value)
            found = json_records(spark, f"file://{path}", in_object=2 if form == "nested" else 0)
            rows = found.orderBy("file", "block", "number").collect()
            assert [json.loads(r.value) for r in rows] == expected
            assert form == "empty" or size > 1000 or spark.read.option("lineSep", "{").text(f"file://{path}").rdd.getNumPartitions() > 5
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)


def test_deepseek(spark, openai_file):
    rows = read_deepseek(spark, openai_file)
    assert {r.source for r in rows.collect()} == {"ChatGPT"} and rows.exceptAll(read_openai(spark, openai_file)).isEmpty()
