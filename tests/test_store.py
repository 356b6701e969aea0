import json

import pytest
from pyspark.sql import functions as F

from mnemolith.functions.vectors import l1_distance
from mnemolith.operators import legacy, recall
from mnemolith.operators.embedding import TermCountEmbedder, resolve_embedder
from mnemolith.operators.memory import raw_documents
from mnemolith.operators.store import MemoryStore, SourceClash, VersionTaken
from mnemolith.sources.chat_exports import blank_dropped, read_openai
from mnemolith.streaming.ingest import ingest_export, watch_exports

EMBEDDER = TermCountEmbedder(["记忆", "向量", "数据库", "检索"])
ONE, TWO = "今天聊了向量检索的第一步。", "向量数据库负责召回相近的记忆单元，再回到它们的原始文档。"


@pytest.fixture()
def export(tmp_path):
    def message(name, role, text, minute):
        return {"message": {"id": name, "author": {"role": role}, "content": {"parts": [text]}, "metadata": {"model_slug": "m"}, "create_time": f"2026-03-18T08:{minute}:00"}}

    talk = {"id": "conv-1", "title": "Plan", "create_time": "2026-03-18T08:30:00", "mapping": {"a": message("msg-1", "user", ONE, 31), "b": message("msg-2", "assistant", TWO, 32)}}
    path = tmp_path / "in" / "chat.json"
    path.parent.mkdir()
    path.write_text(json.dumps([talk]))
    return str(path)


def test_import_twice_and_search(spark, export, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        assert ingest_export(spark, export, store, EMBEDDER) == {"raw_documents": 2, "memory_units": 2}
    assert store.count_rows("raw_documents") == 2 and store.count_rows("vectors") == store.count_rows("memory_units") == 2
    documents, units, vectors = (store.table(t) for t in ("raw_documents", "memory_units", "vectors"))
    assert {r.raw_document_id for r in documents.collect()} == {"chatgpt:conversation_message:msg-1", "chatgpt:conversation_message:msg-2"}
    hits = recall.search_memory(units, documents, vectors, "向量 数据库", EMBEDDER, distance=l1_distance).collect()
    assert [h.score for h in hits] == sorted(h.score for h in hits) and len(hits) == 2
    texts = {r.raw_document_id: r.content for r in documents.collect()}
    for hit in hits:
        assert hit.trace.raw_document_id == hit.raw_document_id and "向量" in texts[hit.raw_document_id]
        assert texts[hit.raw_document_id][hit.trace.start_char : hit.trace.end_char].strip() == hit.content
    assert recall.search_memory(units, documents, vectors, "  ", EMBEDDER).count() == 0
    page = recall.search(units, documents, vectors, "向量", EMBEDDER, recall.Filters.parse({"sort": "time_desc", "end_date": "2026-03-18"})).collect()
    assert [r.timestamp for r in page] == ["2026-03-18 08:32:00", "2026-03-18 08:31:00"]
    body = json.loads(recall.as_response("向量", recall.search_memory(units, documents, vectors, "向量", EMBEDDER)).first().body)
    assert body["count"] == 2 and body["results"][0]["memory_unit_id"]
    payload = recall.unit_payload(units, documents, "chatgpt:conversation_message:msg-1:0").first()
    assert payload.raw_document.content == ONE and payload.memory_unit.unit_index == 0
    assert store.changed(documents).count() == 0
    assert store.vectors_of([]).count() == 0 and store.vectors_of(["chatgpt:conversation_message:msg-1:0"]).count() == 1
    store.delete_vectors(["chatgpt:conversation_message:msg-1:0"])
    assert store.count_rows("vectors") == 1
    store.rollback()
    assert store.count_rows("vectors") == 2
    with pytest.raises(ValueError):
        store.count_rows("users; --")


def test_a_search_moves_no_document(spark, export, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    ingest_export(spark, export, store, EMBEDDER)
    hits = recall.search_memory(*(store.table(t) for t in ("memory_units", "raw_documents", "vectors")), "向量", EMBEDDER)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert plan.count("TakeOrderedAndProject") == 2 and len(hits.collect()) == 2


def test_embedders(spark):
    assert resolve_embedder(EMBEDDER) is EMBEDDER
    shared = resolve_embedder()
    assert shared is resolve_embedder() and shared.version == "BAAI/bge-small-zh-v1.5"
    assert spark.range(1).select(EMBEDDER.embed_query("向量 数据库").alias("v")).first().v == [0.0, 1.0, 1.0, 0.0, 6.0]


def test_lookups(spark, export, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    ingest_export(spark, export, store, EMBEDDER)
    documents, units = store.table("raw_documents"), store.table("memory_units")
    name = "chatgpt:conversation_message:msg-2"
    assert recall.raw_document(documents, name).first().content == TWO and recall.raw_document(documents, "none").isEmpty()
    assert [r.memory_unit_id for r in recall.units_of(units, name).collect()] == [f"{name}:0"]
    chunks = spark.createDataFrame([(7, "msg-1", 1), (3, "msg-1", 0), (5, "msg-0", 0)], "chunk_id long, message_id string, chunk_index int")
    assert [r.chunk_id for r in legacy.in_chunk_order(chunks).collect()] == [5, 3, 7]
    rows = read_openai(spark, export)
    talks = rows.select("conversation_id", "title", F.col("conversation_created_at").alias("created_at"), "source", F.lit("").alias("raw_meta")).distinct()
    messages = rows.drop("title", "conversation_created_at", "source").withColumn("content_hash", F.md5("content"))
    for asked, found in (("7", ["msg-1"]), ("seven", []), ("5", [])):
        assert [r.message_id for r in legacy.message_by_chunk(chunks, messages, talks, asked).collect()] == found


def test_edit_bootstrap_and_clash(spark, export, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    rows = read_openai(spark, export)
    talks = rows.select("conversation_id", "title", F.col("conversation_created_at").alias("created_at"), "source", F.lit(None).cast("string").alias("raw_meta")).distinct()
    messages = rows.drop("title", "conversation_created_at", "source").withColumn("content_hash", F.md5("content"))
    store.save_conversations(talks, messages)
    assert store.bootstrap()["migrated"] is False
    chunk = spark.createDataFrame([(1, "msg-1", 0, 0, len(ONE), ONE, "h", None, None, None, 0)], store.table("chunks").schema)
    store.save_chunks(chunk)
    assert store.bootstrap() == {"migrated": True, "raw_documents": 2, "memory_units": 1}
    assert store.bootstrap()["migrated"] is False
    store.mark_embedded("chunks", "chunk_id", spark.createDataFrame([(1,)], "chunk_id long"))
    assert store.table("chunks").first().is_embedded == 1
    with pytest.raises(SourceClash):
        store.ingest(raw_documents(blank_dropped(rows)), EMBEDDER)
    store.edit_message("msg-1", "New title", TWO * 2, EMBEDDER, sender="editor")
    document = store.table("raw_documents").filter("external_id = 'msg-1'").first()
    assert (document.content, document.title, document.author) == (TWO * 2, "New title", "editor")
    message = store.table("messages").filter("message_id = 'msg-1'").first()
    assert (message.content, message.sender_type, message.content_length) == (TWO * 2, "editor", len(TWO) * 2)
    assert {r.title for r in store.table("vectors").select("metadata.title").collect()} == {"New title"}
    units = store.table("memory_units").filter("raw_document_id = 'legacy:message:msg-1'").collect()
    assert units and all(u.content in TWO * 2 for u in units)
    assert store.table("chunks").filter("message_id = 'msg-1'").count() == 1
    with pytest.raises(ValueError):
        store.edit_message("msg-1", "t", "  ", EMBEDDER)
    with pytest.raises(KeyError):
        store.edit_message("nobody", "t", "text", EMBEDDER)
    store.edit_message("msg-1", " ", TWO, EMBEDDER)
    assert store.table("messages").filter("message_id = 'msg-1'").first().sender_type == "editor"
    assert {r.title for r in store.table("conversations").collect()} == {"New title"}
    for _ in range(2):
        store.rollback()
    assert store.table("raw_documents").filter("external_id = 'msg-1'").first().content == ONE
    assert store.ingest(raw_documents(blank_dropped(rows)), EMBEDDER, supersede=True)["raw_documents"] == 2
    assert store.count_rows("raw_documents") == 2


def test_a_failure_between_steps_leaves_the_version_before(spark, export, tmp_path, monkeypatch):
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    ingest_export(spark, export, store, EMBEDDER)
    before = store.state()
    with monkeypatch.context() as patch:

        def dies(self, state):
            raise RuntimeError("the driver is gone")

        patch.setattr(MemoryStore, "_point", dies)
        with pytest.raises(RuntimeError):
            store.delete_vectors(["chatgpt:conversation_message:msg-1:0"])
    # A pointer that was begun and not renamed.
    (tmp_path / "store" / "versions" / ".half").write_text('{"version": 2')
    assert store.state() == before and store.count_rows("raw_documents") == store.count_rows("vectors") == 2
    assert ingest_export(spark, export, store, EMBEDDER) == {"raw_documents": 2, "memory_units": 2}
    assert store.state()["version"] == 2 and store.count_rows("memory_units") == 2
    late = store.state() | {"version": 2}
    with pytest.raises(VersionTaken):
        store._point(late)
    store.rollback()
    assert store.state()["version"] == 3 and store.state()["tables"] == before["tables"]
    store.rollback()
    assert store.count_rows("raw_documents") == 0 and store.rollback() == 5


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store", buckets=8)
    rows = [("c", f"t{k}", "ChatGPT", f"m{k}", "user", f"Some words of message {k}, and a few more of them.", k) for k in range(60)]
    messages = spark.createDataFrame([(c, t, s, m, a, x, k, "", "", "", "", len(x)) for c, t, s, m, a, x, k in rows], "conversation_id string, title string, source string, message_id string, sender_type string, content string, sequence int, timestamp string, conversation_created_at string, sub_title string, model string, content_length int")
    store.ingest(raw_documents(messages), EMBEDDER)
    before = store.state()["tables"]["raw_documents"]
    assert len(before) == 8
    changed = messages.filter("message_id = 'm7'").withColumn("content", F.lit("Now something else, longer than thirty characters."))
    store.ingest(raw_documents(changed), EMBEDDER)
    after = store.state()["tables"]["raw_documents"]
    assert sum(before[n] != after[n] for n in before) == 1
    assert store.count_rows("raw_documents") == store.count_rows("memory_units") == store.count_rows("vectors") == 60
    assert store.table("raw_documents").filter("external_id = 'm7'").first().content.startswith("Now")


def test_the_later_reading_of_a_message_wins_and_conversations_keep_their_json(spark, tmp_path):
    def talk(text, **more):
        return {"id": "c", "title": "T", "mapping": {"a": {"message": {"id": "m", "content": {"parts": [text]}}}}, **more}

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps([talk("z first of all"), talk("a second", extra={"deep": [1, 2]})]))
    (folder / "2.json").write_text(json.dumps([talk("b third", plugin="p")]))
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    ingest_export(spark, f"file://{folder}/1.json", store, EMBEDDER)
    assert store.table("raw_documents").first().content == "a second"
    assert json.loads(store.table("conversation_records").first().raw_meta)["extra"] == {"deep": [1, 2]}
    watch_exports(spark, f"file://{folder}", store, EMBEDDER, f"file://{tmp_path}/seen").awaitTermination()
    assert store.table("raw_documents").first().content == "b third" and store.count_rows("conversation_records") == 1
    assert json.loads(store.table("conversation_records").first().raw_meta)["plugin"] == "p"


def test_watched_folder_reads_each_file_once(spark, export, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        watch_exports(spark, f"file://{tmp_path}/in", store, EMBEDDER, f"file://{tmp_path}/seen").awaitTermination()
    assert store.state()["version"] == 1 and store.count_rows("raw_documents") == 2


def test_command_line(spark, export, tmp_path, capsys):
    from mnemolith.__main__ import main

    assert main(["--file", export, "--store", f"file://{tmp_path}/cli", "--terms", "向量"]) == {"raw_documents": 2, "memory_units": 2}
    assert json.loads(capsys.readouterr().out) == {"raw_documents": 2, "memory_units": 2}
