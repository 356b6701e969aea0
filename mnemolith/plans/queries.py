"""Registered queries of the archive and recall engine.

Messages come from the ``conversations`` table: each turn is a message, its
conversation started ``conv_id % 365`` days into 2024. Its older layout has the
conversations with more than one turn, so turns of others are orphans, and
chunks of all turns but the system's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunking import chunks
from ..functions.text import content_hash, preview, strip, summary
from ..functions.timestamps import format_timestamp, normalize_timestamp
from ..functions.vectors import l1_distance
from ..operators import legacy, memory, recall, store
from ..operators.archive_search import ArchiveSearch
from ..operators.embedding import TermCountEmbedder, vectors
from ..operators.vector_index import VectorIndex
from ..scratch import shared_path
from ..settings import Settings
from ..sources.chat_exports import blank_dropped, conversation_records, read_deepseek, read_grok, read_openai
from ..streaming.ingest import ingest_stream

TERMS = ["the", "and", "ing", "tion", "de", "que", "ch"]
QUERY = "the thing and de"
VERSION = "term-counts"
DIGITS = 6  # distances are compared with those of another engine


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")), "yyyy-MM-dd 00:00:00")
    return _read(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.concat(F.lit("Conversation "), "conv_id").alias("title"),
        F.lit("").alias("conversation_created_at"),
        F.lit("ChatGPT").alias("source"),
        F.lit(None).cast("string").alias("sub_title"),
        F.col("role").alias("sender_type"),
        F.col("text").alias("content"),
        F.length("text").alias("content_length"),
        F.lit("unknown").alias("model"),
        F.col("turn").cast("int").alias("sequence"),
        day.alias("timestamp"),
        "conv_id",
        "turn",
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.raw_documents(blank_dropped(_messages(spark, sf_dir)).drop("conv_id", "turn"))


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = _documents(spark, sf_dir)
    units = memory.memory_units(documents, VERSION, with_document=True)
    return documents, units.drop("document"), vectors(units, TermCountEmbedder(TERMS))


def _older(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(messages, conversations, chunks)`` of the older layout."""
    rows = _messages(spark, sf_dir)
    messages = rows.drop("title", "source", "conversation_created_at").withColumn("content_hash", content_hash(F.col("content")))
    several = rows.groupBy("conversation_id").agg(F.count("*").alias("turns"), F.min("title").alias("title"), F.min("timestamp").alias("created_at")).filter("turns > 1")
    conversations = several.select("conversation_id", "title", "created_at", F.lit("ChatGPT").alias("source"), F.lit(None).cast("string").alias("raw_meta"))
    pieces = rows.filter("sender_type <> 'system'").select("message_id", "conv_id", "turn", "sender_type", F.posexplode(chunks(F.col("content"))).alias("chunk_index", "c"))
    return (
        messages,
        conversations,
        pieces.select(
            (F.col("conv_id") * 10_000_000 + F.col("turn") * 10_000 + F.col("chunk_index")).cast("long").alias("chunk_id"),
            "message_id", "chunk_index", "c.start_char", "c.end_char", "c.content",
            content_hash(F.col("c.content")).alias("hash"),
            F.lit(None).cast("string").alias("embedding_version"),
            (F.col("sender_type") == "assistant").cast("int").alias("is_embedded"),
        ),
    )


def raw_documents_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "raw_document_id", "source", "source_type", "external_id", "root_document_id", "title", "author", "created_at", "content_hash"
    )


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "documents").select("doc_id", F.explode(chunks(F.col("text"))).alias("c"))
    return found.select("doc_id", F.col("c.start_char").cast("long").alias("start_char"), F.col("c.end_char").cast("long").alias("end_char"), F.md5("c.content").alias("content_md5"))


def _unit_columns(units: DataFrame) -> DataFrame:
    return units.select(
        "memory_unit_id", "raw_document_id", F.col("unit_index").cast("long").alias("unit_index"), "unit_type",
        F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"),
        F.md5("content").alias("content_md5"), "summary",
    )


def memory_units_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_columns(_layers(spark, sf_dir)[1])


def unit_counts_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.unit_counts(_layers(spark, sf_dir)[1])


def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, units, _ = _layers(spark, sf_dir)
    return memory.import_counters(documents, units)


def summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", summary(F.col("text")).alias("summary"))


def preview_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", preview(F.col("text"), QUERY).alias("preview"))


def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _read(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def chunk_hash_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose whole text is a chunk of some message."""
    messages, _, pieces = _older(spark, sf_dir)
    return legacy.hash_exists(pieces, messages.select("message_id", F.col("content_hash").alias("hash"))).select("message_id")


def _vector_query(spark: SparkSession, sf_dir: str, distance) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    one = F.broadcast(rows.filter("id = 0").select(F.col("embedding").alias("query")))  # one vector
    found = recall.nearest(rows.crossJoin(one), F.col("query"), 10, distance, DIGITS)
    return found.select(F.col("id").alias("vec_id"), F.col("score").alias("distance"))


def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_query(spark, sf_dir, recall.cosine_distance)


def vector_topk_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_query(spark, sf_dir, l1_distance)


def term_count_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: conversations archived, cut, embedded, searched and traced."""
    documents, units, found = _layers(spark, sf_dir)
    hits = recall.search_memory(units, documents, found, QUERY, TermCountEmbedder(TERMS), limit=10, digits=DIGITS)
    trace = {"external_id": "trace.external_id", "root_document_id": "trace.root_document_id"}
    return hits.select(
        "memory_unit_id", "score", "summary", "preview", "source", "source_type", "title", "author", "created_at", "raw_document_id",
        *[F.col(path).alias(name) for name, path in trace.items()],
        F.col("trace.start_char").cast("long").alias("start_char"), F.col("trace.end_char").cast("long").alias("end_char"),
    )


def _page(spark: SparkSession, sf_dir: str, filters: recall.Filters) -> DataFrame:
    documents, units, found = _layers(spark, sf_dir)
    page = recall.search(units, documents, found, QUERY, TermCountEmbedder(TERMS), filters, digits=DIGITS)
    return page.select("chunk_id", "message_id", "timestamp", F.col("char_count").cast("long").alias("char_count"), "title", "preview", "score")


def recall_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, recall.Filters())


def recall_time_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, recall.Filters.parse({"sort": "time_asc"}))


def recall_time_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, recall.Filters.parse({"sort": "time_desc"}))


def recall_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, recall.Filters.parse({"min_length": "60", "start_date": "2024-01-05", "end_date": "2024-03-20"}))


def trace_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, units, _ = _layers(spark, sf_dir)
    return recall.detail(units, documents).select(
        "memory_unit_id", "raw_document_id", "external_id", "root_document_id", "title", "author", "created_at",
        F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"),
        F.md5("raw_content").alias("raw_md5"),
    )


def legacy_messages_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, conversations, _ = _older(spark, sf_dir)
    rows = legacy.in_message_order(legacy.messages_with_conversations(messages, conversations))
    return rows.select("message_id", "conversation_id", "title", "sender_type", "content_hash", F.col("sequence").cast("long").alias("sequence"), "timestamp", "source")


def legacy_message_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, conversations, pieces = _older(spark, sf_dir)
    rows = legacy.message_by_chunk(pieces, messages, conversations)
    return rows.select("chunk_id", "message_id", "conversation_id", "title", "sender_type", "content_hash", F.col("content_length").cast("long").alias("content_length"))


def grouped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.grouped_chunks(_older(spark, sf_dir)[2])
    ids = F.array_join(F.transform("chunks", lambda c: c["chunk_id"].cast("string")), ",")
    return rows.select("message_id", F.size("chunks").cast("long").alias("n"), ids.alias("chunk_ids"))


def messages_needing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, conversations, pieces = _older(spark, sf_dir)
    return legacy.messages_needing_chunks(messages, conversations, pieces).select("message_id", "title", "sender_type")


def unprocessed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, conversations, pieces = _older(spark, sf_dir)
    rows = legacy.unprocessed_chunks(pieces, messages, conversations, 100)
    return rows.select("chunk_id", "message_id", "title", "timestamp", F.md5("content").alias("content_md5"))


def bootstrap_raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, conversations, _ = _older(spark, sf_dir)
    rows = legacy.bootstrap_documents(messages, conversations)
    return rows.select("raw_document_id", "source", "source_type", "external_id", "root_document_id", "title", "author", "created_at", "content_hash", "raw_payload")


def bootstrap_memory_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, conversations, pieces = _older(spark, sf_dir)
    rows = legacy.bootstrap_units(messages, conversations, pieces)
    return rows.select(
        "memory_unit_id", "raw_document_id", F.col("unit_index").cast("long").alias("unit_index"), "unit_type", F.md5("content").alias("content_md5"), "summary", "embedding_version",
        F.col("is_embedded").cast("long").alias("is_embedded"),
    )


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each conversation's user turns, overwritten by the turns of its assistant."""
    rows = _messages(spark, sf_dir).select(F.col("conversation_id").alias("raw_document_id"), "sender_type", "turn", content_hash(F.col("content")).alias("content_hash"))
    old = store.last_wins(rows.filter("sender_type = 'user'"), ["raw_document_id"], "turn")
    new = store.last_wins(rows.filter("sender_type = 'assistant'"), ["raw_document_id"], "turn")
    return store.upserted(old, new, ["raw_document_id"]).select("raw_document_id", "sender_type", "content_hash")


def replace_memory_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all turns, those of system turns replaced by one unit each."""
    documents, units, _ = _layers(spark, sf_dir)
    parents = documents.filter("author = 'system'")
    whole = parents.select(F.concat("raw_document_id", F.lit(":new")).alias("memory_unit_id"), "raw_document_id", content_hash(F.col("content")).alias("content_md5"))
    old = units.select("memory_unit_id", "raw_document_id", F.md5("content").alias("content_md5"))
    return store.children_replaced(old, whole, parents, "raw_document_id")


def source_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrapped documents that an import of the same messages would clash with."""
    messages, conversations, _ = _older(spark, sf_dir)
    old = legacy.bootstrap_documents(messages, conversations)
    return store.source_clashes(old, _documents(spark, sf_dir))


def sequence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).filter(strip(F.col("content")) != "")
    order = Window.partitionBy("conversation_id").orderBy("turn")
    return rows.select("message_id", (F.row_number().over(order) - 1).cast("long").alias("sequence"))


def normalize_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))
    return _read(spark, sf_dir, "events").select("event_id", normalize_timestamp(forms).alias("normalized"))


def format_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds, milliseconds in ``$date`` and ISO text of the events' times, by user."""
    seconds = F.unix_timestamp("ts")
    json = (
        F.when(F.col("user_id") % 3 == 0, seconds.cast("string"))
        .when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"$date":{"$numberLong":"'), seconds * 1000, F.lit('"}}')))
        .otherwise(F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')))
    )
    return _read(spark, sf_dir, "events").select("event_id", format_timestamp(F.parse_json(json)).alias("formatted"))


def count_rows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["conversations", "documents", "embeddings", "events", "labels", "pages", "benchmark"]
    counts = [_read(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    return reduce(DataFrame.unionByName, counts)


def metadata_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, conversations, _ = _older(spark, sf_dir)
    return legacy.metadata_values(messages, conversations)


def _export(spark: SparkSession, sf_dir: str, name: str, form: str) -> str:
    """Write the conversations as export files of sixteen conversations, each a whole JSON document."""
    path = shared_path(spark, name)
    rows = _messages(spark, sf_dir)
    if form == "openai":
        node = F.struct(
            F.struct(
                F.col("message_id").alias("id"),
                F.struct(F.col("sender_type").alias("role")).alias("author"),
                F.struct(F.array("content").alias("parts")).alias("content"),
                F.struct(F.lit("m-1").alias("model_slug")).alias("metadata"),
                F.col("timestamp").alias("create_time"),
            ).alias("message")
        )
        by = rows.groupBy("conv_id", "conversation_id", "title").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("message_id").alias("id"), node.alias("node")))).alias("nodes"))
        mapping = F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["id"], n["node"])))
        talk = F.struct(F.col("conversation_id").alias("id"), "title", mapping.alias("mapping"))
        body = F.to_json("talks")
    else:
        reply = F.struct(
            F.struct(F.col("message_id").alias("_id"), F.col("content").alias("message"), F.col("sender_type").alias("sender"), F.lit("m-1").alias("model_slug"), F.col("timestamp").alias("create_time")).alias("response")
        )
        by = rows.groupBy("conv_id", "conversation_id", "title").agg(F.sort_array(F.collect_list(F.struct("turn", reply.alias("reply")))).alias("nodes"))
        talk = F.struct(F.struct(F.col("conversation_id").alias("id"), "title").alias("conversation"), F.transform("nodes", lambda n: n["reply"]).alias("responses"))
        body = F.to_json(F.struct(F.col("talks").alias("conversations")))
    files = by.groupBy(F.expr("conv_id div 16").alias("file")).agg(F.collect_list(talk).alias("talks"))
    files.select("file", body.alias("value")).write.partitionBy("file").text(path)
    return path


def _as_lines(spark: SparkSession, path: str, reader) -> DataFrame:
    found = reader(spark, path)
    return found.select(
        "conversation_id", "title", "source", "message_id", "sender_type", F.md5("content").alias("content_md5"), F.col("content_length").cast("long").alias("content_length"),
        "model", F.col("sequence").cast("long").alias("sequence"), "timestamp",
    )


def openai_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lines(spark, _export(spark, sf_dir, "openai", "openai"), read_openai)


def grok_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lines(spark, _export(spark, sf_dir, "grok", "grok"), read_grok)


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive after its messages came twice as a stream."""
    source = shared_path(spark, "messages")
    rows = _messages(spark, sf_dir).drop("conv_id", "turn")
    rows.write.parquet(source)
    archive = store.MemoryStore(spark, shared_path(spark, "archive"))
    for run in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ingest_stream(stream, archive, TermCountEmbedder(TERMS), shared_path(spark, f"stream-{run}")).awaitTermination()
    return archive.table("memory_units").select("memory_unit_id", "raw_document_id", F.md5("content").alias("content_md5"), F.col("is_embedded").cast("long").alias("is_embedded"))


def edit_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the edited message and the other messages of its conversation after an edit."""
    messages, conversations, pieces = _older(spark, sf_dir)
    archive = store.MemoryStore(spark, shared_path(spark, "archive"))
    plain = messages.drop("conv_id", "turn")
    dated = pieces.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
    archive.commit({"messages": plain, "conversations": conversations, "chunks": dated})
    archive.bootstrap()
    message = archive.table("messages").agg(F.min("message_id")).first()[0]
    archive.edit_message(message, "Edited", "First line of the new text, long enough.\nAnd one more line of it.", TermCountEmbedder(TERMS))
    own = archive.table("messages").select("message_id", "conversation_id").join(archive.table("conversations").select("conversation_id", "title"), "conversation_id")
    rows = archive.table("chunks").join(own, "message_id")
    return rows.select("message_id", F.col("chunk_index").cast("long").alias("chunk_index"), "title", F.md5("content").alias("content_md5"), F.col("is_embedded").cast("long").alias("is_embedded"))


def raw_document_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    least = documents.agg(F.min("raw_document_id")).first()[0]
    return recall.raw_document(documents, least).select("raw_document_id", "source", "external_id", "title", "author", "content_hash")


def units_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the document that has most."""
    _, units, _ = _layers(spark, sf_dir)
    most = memory.unit_counts(units).orderBy(F.desc("units"), "raw_document_id").first()[0]
    return _unit_columns(recall.units_of(units, most)).drop("summary")


def unit_payload_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, units, _ = _layers(spark, sf_dir)
    least = units.agg(F.min("memory_unit_id")).first()[0]
    found = recall.unit_payload(units, documents, least)
    return found.select(
        "memory_unit.memory_unit_id", F.col("memory_unit.unit_index").cast("long").alias("unit_index"), "memory_unit.summary", "raw_document.raw_document_id", "raw_document.created_at",
        F.md5("raw_document.content").alias("raw_md5"), F.variant_get("memory_unit.metadata", "$.author", "string").alias("author"),
        F.variant_get("raw_document.metadata", "$.sequence", "long").alias("sequence"),
    )


def chunks_of_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the message that has most."""
    pieces = _older(spark, sf_dir)[2]
    most = pieces.groupBy("message_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message_id").first()[0]
    return legacy.chunks_of(pieces, most).select("chunk_id", "message_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legacy.in_chunk_order(_older(spark, sf_dir)[2])
    return rows.select("chunk_id", "message_id", F.col("chunk_index").cast("long").alias("chunk_index"))


def edit_metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata for editing of all messages, their raw metadata being a title, another source and a tag."""
    rows = _messages(spark, sf_dir)
    raw = F.to_json(F.struct("title", F.lit("elsewhere").alias("source"), F.array("sender_type").alias("tags")))
    edited = rows.select("message_id", legacy.edit_metadata(raw, F.col("source"), F.col("model")).alias("edit"))
    return edited.select("message_id", *[F.col("edit.fields")[f].alias(f) for f in ("title", "source", "model")], F.array_join("edit.tags", ",").alias("tags"))


def _archive(spark: SparkSession, sf_dir: str) -> store.MemoryStore:
    archive = store.MemoryStore(spark, shared_path(spark, "archive"))
    archive.ingest(_documents(spark, sf_dir), TermCountEmbedder(TERMS))
    return archive


def rollback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's units after all documents were changed and the change was rolled back."""
    archive = _archive(spark, sf_dir)
    archive.ingest(_documents(spark, sf_dir).withColumn("content", F.concat("content", F.lit(" changed"))), TermCountEmbedder(TERMS))
    archive.rollback()
    return archive.table("memory_units").select("memory_unit_id", "raw_document_id", F.md5("content").alias("content_md5"))


def mark_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after those of user turns were marked as embedded, as the assistant's are."""
    messages, conversations, pieces = _older(spark, sf_dir)
    archive = store.MemoryStore(spark, shared_path(spark, "archive"))
    archive.save_conversations(conversations, messages.drop("conv_id", "turn"))
    archive.save_chunks(pieces)
    archive.mark_embedded("chunks", "chunk_id", pieces.join(messages.filter("sender_type = 'user'"), "message_id", "left_semi"))
    return archive.table("chunks").select("chunk_id", F.col("is_embedded").cast("long").alias("is_embedded"))


def save_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that stay when all user turns are saved again, and their conversations' titles."""
    messages, conversations, pieces = _older(spark, sf_dir)
    plain = messages.drop("conv_id", "turn")
    archive = store.MemoryStore(spark, shared_path(spark, "archive"))
    archive.save_conversations(conversations, plain)
    archive.save_chunks(pieces)
    archive.save_conversations(conversations.withColumn("title", F.concat("title", F.lit(" again"))), plain.filter("sender_type = 'user'"))
    joined = legacy.messages_with_conversations(archive.table("messages"), archive.table("conversations"))
    return joined.join(archive.table("chunks").select("message_id", "chunk_id"), "message_id", "left").select("message_id", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), "title")


def vectors_read_and_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five vectors by identifier after two of them were deleted."""
    archive = _archive(spark, sf_dir)
    ids = [r["id"] for r in archive.table("vectors").select("id").orderBy("id").limit(5).collect()]
    archive.delete_vectors(ids[:2])
    return archive.vectors_of(ids).select("id", "metadata.raw_document_id", F.element_at("embedding", -1).alias("length"))


def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the archive's tables after an import."""
    archive = _archive(spark, sf_dir)
    return spark.createDataFrame([(name, archive.count_rows(name)) for name in ("raw_documents", "memory_units", "vectors", "messages")], "name string, n long")


def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON body of a search, read again."""
    documents, units, found = _layers(spark, sf_dir)
    body = recall.as_response(QUERY, recall.search_memory(units, documents, found, QUERY, TermCountEmbedder(TERMS), limit=10, digits=DIGITS))
    read = body.select(F.from_json("body", "query string, count long, results array<struct<memory_unit_id:string,raw_document_id:string,score:double>>").alias("b"))
    return read.select("b.query", "b.count", F.posexplode("b.results").alias("place", "hit")).select("query", "count", F.col("place").cast("long").alias("place"), "hit.memory_unit_id", "hit.raw_document_id", "hit.score")


def conversation_records_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's own JSON of an export, by its title and messages."""
    records = conversation_records(spark, _export(spark, sf_dir, "openai", "openai"))
    nodes = F.size(F.json_object_keys(F.get_json_object("raw_meta", "$.mapping"))).cast("long")
    return records.select("conversation_id", "source", "title", F.get_json_object("raw_meta", "$.title").alias("own_title"), nodes.alias("nodes"))


def vector_topk_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors where a third of them is null, of zeros, or one number short."""
    kind = F.col("vec_id") % 9
    odd = F.when(kind == 3, F.lit(None)).when(kind == 4, F.transform("embedding", lambda x: x * 0)).when(kind == 5, F.slice("embedding", 2, 10_000)).otherwise(F.col("embedding"))
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), odd.alias("embedding"))
    one = F.broadcast(rows.filter("id = 0").select(F.col("embedding").alias("query")))  # one vector
    found = recall.nearest(rows.crossJoin(one), F.col("query"), 10, digits=DIGITS)
    return found.select(F.col("id").alias("vec_id"), F.col("score").alias("distance"))


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors from an index of all embeddings, through all its lists.

    Distances that are equal to six decimals count as equal, as in SQL. The vectors stand in no groups, so that fewer lists would miss some (tests measure that where they do).
    """
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.build(rows, shared_path(spark, "index"), lists=16)
    query = rows.filter("id = 0").first()["embedding"]
    return index.nearest(query, 10, probes=16, digits=DIGITS).select(F.col("id").alias("vec_id"), F.col("score").alias("distance"))


def pruned_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document, units and vectors of the archive's last document, each from one bucket."""
    archive = _archive(spark, sf_dir)
    last = archive.table("raw_documents").agg(F.max("raw_document_id")).first()[0]
    search = ArchiveSearch(archive, TermCountEmbedder(TERMS))
    units = search.units(last).select("memory_unit_id", "raw_document_id", F.md5("content").alias("content_md5"))
    payload = search.unit(f"{last}:0").select(F.md5("raw_document.content").alias("raw_md5"))  # one row
    found = archive.vectors_of([r["memory_unit_id"] for r in units.collect()]).select(F.col("id").alias("memory_unit_id"), "embedding_version")  # one document's
    documents = search.document(last).select("raw_document_id", "external_id")
    return units.join(documents, "raw_document_id").join(found, "memory_unit_id").crossJoin(F.broadcast(payload))


def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a search in a store, from the buckets of their documents."""
    hits = ArchiveSearch(_archive(spark, sf_dir), TermCountEmbedder(TERMS)).memory(QUERY, 50)
    return hits.select("memory_unit_id", F.round("score", DIGITS).alias("score"), "title", "author", "created_at", "trace.external_id", F.md5("content").alias("content_md5"))


def filled_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page under a selective filter, by a search that widens from ten vectors on."""
    search = ArchiveSearch(_archive(spark, sf_dir), TermCountEmbedder(TERMS), Settings(default_search_k=10, max_results_display=20))
    page = search.page(QUERY, recall.Filters.parse({"min_length": "100", "start_date": "2024-01-03", "end_date": "2024-01-20", "sort": "time_asc"}))
    return page.select("chunk_id", "message_id", "timestamp", F.col("char_count").cast("long").alias("char_count"), F.round("score", DIGITS).alias("score"))


def _older_archive(spark: SparkSession, sf_dir: str) -> store.MemoryStore:
    messages, conversations, pieces = _older(spark, sf_dir)
    archive = store.MemoryStore(spark, shared_path(spark, "archive"))
    archive.commit({"messages": messages.drop("conv_id", "turn"), "conversations": conversations, "chunks": pieces})
    archive.bootstrap()
    return archive


def restored_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, chunks and documents after edits of the first and last message and the restoring of the first."""
    archive, embedder = _older_archive(spark, sf_dir), TermCountEmbedder(TERMS)
    before = archive.state()["version"]
    first, last = archive.table("messages").join(archive.table("conversations"), "conversation_id", "left_semi").agg(F.min("message_id"), F.max("message_id")).first()
    archive.edit_message(first, "Edited", "A new text of the first message, long enough to stay.", embedder)
    archive.edit_message(last, "Edited too", "A new text of the last message, long enough to stay.", embedder)
    archive.restore_message(first, before)
    chunks = archive.table("chunks").groupBy("message_id").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("chunk_id"))
    documents = archive.table("raw_documents").select(F.col("external_id").alias("message_id"), F.md5("content").alias("document_md5"), F.col("title").alias("document_title"))
    rows = archive.table("messages").join(archive.table("conversations").select("conversation_id", "title"), "conversation_id").join(chunks, "message_id", "left").join(documents, "message_id")
    return rows.select("message_id", F.md5("content").alias("content_md5"), "title", "document_md5", "document_title", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"))


class _Dear(TermCountEmbedder):
    """Counts of terms, as if they were dear to compute."""

    reuse = True


def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded by an import, by the same again, and by one after the embedder changed; vectors of each version in the end."""
    archive = store.MemoryStore(spark, shared_path(spark, "archive"))
    documents = _documents(spark, sf_dir)
    counts = [archive.ingest(documents, _Dear(TERMS, version))["embedded"] for version in ("one", "one", "two")]
    kept = {r["embedding_version"]: r["count"] for r in archive.table("vectors").groupBy("embedding_version").count().collect()}
    return spark.createDataFrame([("import", counts[0]), ("import again", counts[1]), ("another version", counts[2]), ("vectors of one", kept.get("one", 0)), ("vectors of two", kept.get("two", 0))], "step string, n long")


def replayed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and counters when a stream's batches come twice."""
    archive, embedder, documents = store.MemoryStore(spark, shared_path(spark, "archive")), TermCountEmbedder(TERMS), _documents(spark, sf_dir)
    rows = []
    for step, number in enumerate((0, 0, 1, 1)):
        counters = archive.ingest(documents, embedder, batch=("stream", number))
        rows.append((step, counters["raw_documents"], counters["memory_units"], archive.state()["version"]))
    return spark.createDataFrame(rows, "step long, raw_documents long, memory_units long, version long")


def numbered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a store gives to chunks that have none, and to those of an edit."""
    messages, conversations, pieces = _older(spark, sf_dir)
    archive = store.MemoryStore(spark, shared_path(spark, "archive"))
    archive.save_conversations(conversations, messages.drop("conv_id", "turn"))
    archive.save_chunks(pieces.drop("chunk_id"))
    least = archive.table("messages").agg(F.min("message_id")).first()[0]
    edited = archive.edit_message(least, "", "A first sentence that is long enough to stand alone.", TermCountEmbedder(TERMS))["chunk_ids"]
    own = archive.table("chunks").filter(~F.col("chunk_id").isin(*edited)).agg(F.count("*").alias("chunks"), F.countDistinct("chunk_id").alias("numbers"))
    return own.select("chunks", "numbers", F.lit(edited[0]).cast("long").alias("edited"))


def marked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units marked as embedded, of documents by the assistant, in an archive of the older layout."""
    archive = _older_archive(spark, sf_dir)
    units = archive.table("memory_units").join(archive.table("raw_documents").filter("author = 'user'").select("raw_document_id"), "raw_document_id", "left_semi")
    archive.mark_embedded("memory_units", "memory_unit_id", units.select("memory_unit_id"))
    return archive.table("memory_units").select("memory_unit_id", F.col("is_embedded").cast("long").alias("is_embedded"))


def vectors_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after a message was edited and the edit rolled back."""
    archive = _archive(spark, sf_dir)
    archive.save_conversations(_older(spark, sf_dir)[1], _older(spark, sf_dir)[0].drop("conv_id", "turn"))
    least = archive.table("messages").join(archive.table("conversations"), "conversation_id", "left_semi").agg(F.min("message_id")).first()[0]
    archive.edit_message(least, "New", "A new text that is long enough to be a unit.", TermCountEmbedder(TERMS))
    archive.rollback()
    return archive.table("vectors").select("id", F.element_at("embedding", -1).alias("length"), "metadata.title", F.md5("document").alias("content_md5"))


def edited_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of an edited message, embedded again, and their metadata."""
    archive = _older_archive(spark, sf_dir)
    least = archive.table("messages").join(archive.table("conversations"), "conversation_id", "left_semi").agg(F.min("message_id")).first()[0]
    archive.edit_message(least, "", "The thing and the rest of que de ch, long enough.", TermCountEmbedder(TERMS), sender="editor")
    found = archive.table("vectors").select("metadata.raw_document_id", "metadata.title", "metadata.author", "metadata.source", "document", "embedding")
    return found.select("raw_document_id", "title", "author", "source", "document", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


def _one_file(spark: SparkSession, sf_dir: str, form: str) -> str:
    """All conversations as one export file, written line by line by one task."""
    parts = spark.read.text(_export(spark, sf_dir, form, form)).select("value")
    kind = "array<string>" if form == "openai" else "struct<conversations:array<string>>"
    talks = F.from_json("value", kind)
    listed = parts.select(F.explode(talks if form == "openai" else talks["conversations"]).alias("talk"))
    path = shared_path(spark, f"{form}-one")
    start, end = ("[", "]") if form == "openai" else ('{"about": "an export", "conversations": [', '], "projects": [{"name": "p"}]}')
    lines = listed.select(F.lit(1).alias("part"), F.col("talk")).unionByName(spark.createDataFrame([(0, start), (3, end)], "part int, talk string"))
    first = F.row_number().over(Window.partitionBy("part").orderBy("talk")) == 1  # one file has one order
    lines.select("part", F.when((F.col("part") != 1) | first, F.col("talk")).otherwise(F.concat(F.lit(","), "talk")).alias("value"), (~first).alias("later")).coalesce(1).sortWithinPartitions("part", "later").select("value").write.text(path)
    return path


def _by_ranges(spark: SparkSession, read) -> DataFrame:
    """What ``read`` finds where files are cut every 64 KB."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("64k", "1k"), strict=True):
        spark.conf.set(n, value)
    try:
        path = shared_path(spark, "records")
        read().write.parquet(path)
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)
    return spark.read.parquet(path)


def split_openai_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One large export, read by ranges in many tasks."""
    path = _one_file(spark, sf_dir, "openai")
    return _by_ranges(spark, lambda: _as_lines(spark, path, read_openai))


def split_grok_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _one_file(spark, sf_dir, "grok")
    return _by_ranges(spark, lambda: _as_lines(spark, path, read_grok))


def deepseek_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_lines(spark, _export(spark, sf_dir, "deepseek", "openai"), read_deepseek)


QUERIES = {
    f.__name__: f
    for f in (
        raw_documents_from_conversations, chunk_documents, memory_units_conversations, unit_counts_by_document, import_counters,
        summary_documents, preview_documents, content_hash_dedupe, chunk_hash_exists, vector_topk_cosine, vector_topk_l1,
        term_count_recall, recall_default, recall_time_asc, recall_time_desc, recall_filtered, trace_detail,
        legacy_messages_scan, legacy_message_by_chunk, grouped_chunks, messages_needing_chunks, unprocessed_chunks,
        bootstrap_raw_documents, bootstrap_memory_units, upsert_last_wins, replace_memory_units, source_clashes, sequence_numbers,
        normalize_timestamps, format_timestamps, count_rows_all, metadata_values, openai_export, grok_export, stream_ingest, edit_replace,
        raw_document_by_id, units_of_document, unit_payload_by_id, chunks_of_message, chunk_scan, edit_metadata_fields, rollback_state,
        mark_embedded, save_conversations, vectors_read_and_deleted, archive_counts, search_response, conversation_records_kept,
        vector_topk_odd, vector_index_topk, pruned_lookups, archive_search, filled_page, restored_message, embedding_reuse, replayed_batch,
        numbered_chunks, marked_units, vectors_rolled_back, edited_vectors, split_openai_export, split_grok_export, deepseek_export,
    )
}
