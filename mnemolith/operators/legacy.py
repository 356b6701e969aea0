"""The older layout: conversations, messages and chunks, and its projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import chunks_or_whole
from ..functions.text import content_hash, filled, json_object, parsed_json, summary
from ..settings import Settings

#: Fields that a metadata form offers.
METADATA_FIELDS = ("title", "source", "sender_type", "model")


def messages_with_conversations(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages with their conversation; those without one are dropped."""
    own = conversations.select("conversation_id", "title", F.col("created_at").alias("conversation_created_at"), "source", "raw_meta")
    return messages.join(own, "conversation_id")


def in_message_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("conversation_id", "sequence", "message_id")


def chunks_of(chunks: DataFrame, message_id: str) -> DataFrame:
    """One message's chunks in order."""
    return chunks.filter(F.col("message_id") == message_id).orderBy("chunk_index", "chunk_id")


def in_chunk_order(chunks: DataFrame) -> DataFrame:
    """All chunks by message and place."""
    return chunks.orderBy("message_id", "chunk_index", "chunk_id")


def grouped_chunks(chunks: DataFrame) -> DataFrame:
    """Each message's chunks as one ordered array (a message has few)."""
    row = F.struct("chunk_index", "chunk_id", "start_char", "end_char", "content")
    return chunks.groupBy("message_id").agg(F.sort_array(F.collect_list(row)).alias("chunks"))


def hash_exists(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of ``hashes(hash)`` that some chunk has."""
    return hashes.join(chunks.select("hash"), "hash", "left_semi")


def messages_needing_chunks(messages: DataFrame, conversations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Messages of known conversations that have no chunk."""
    without = messages.join(chunks.select("message_id"), "message_id", "left_anti")
    return messages_with_conversations(without, conversations).select("message_id", "content", "title", "sender_type")


def unprocessed_chunks(chunks: DataFrame, messages: DataFrame, conversations: DataFrame, limit: int = 100) -> DataFrame:
    """The first chunks, by identifier, that are not embedded yet."""
    waiting = chunks.filter("is_embedded = 0").select("chunk_id", "message_id", "content")
    facts = messages_with_conversations(messages, conversations).select("message_id", "sub_title", "timestamp", "model", "title", "source")
    return waiting.join(facts, "message_id").orderBy("chunk_id").limit(limit)


def message_by_chunk(chunks: DataFrame, messages: DataFrame, conversations: DataFrame, chunk_id: str | None = None) -> DataFrame:
    """Chunks with their message; ``chunk_id`` may be text, and text that is no number finds nothing."""
    chosen = chunks if chunk_id is None else chunks.filter(F.col("chunk_id") == F.lit(chunk_id).try_cast("bigint"))
    facts = messages_with_conversations(messages, conversations).select(
        "message_id", "content", "content_length", "content_hash", "sender_type", "timestamp", "model", "conversation_id", "title", "source", "raw_meta"
    )
    return chosen.select("chunk_id", "message_id").join(facts, "message_id")


def metadata_values(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each value of the metadata fields and how many messages have it."""
    rows = messages_with_conversations(messages, conversations)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in METADATA_FIELDS])).alias("pair")
    return rows.select(pairs).groupBy("pair.field", "pair.value").agg(F.count("*").alias("n"))


def edit_metadata(raw_meta: Column, source: Column, model: Column) -> Column:
    """A message's metadata for editing: the raw fields, source and model over them, and tags."""
    fields = F.from_json(F.to_json(parsed_json(raw_meta)), "map<string,string>")
    over = F.create_map(F.lit("source"), source, F.lit("model"), model)
    kept = F.map_filter(fields, lambda key, value: ~key.isin("source", "model"))
    tags = F.coalesce(F.try_variant_get(parsed_json(raw_meta), "$.tags", "array<string>"), F.array().cast("array<string>"))
    return F.struct(F.map_concat(kept, over).alias("fields"), tags.alias("tags"))


def bootstrap_documents(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Archive rows of older messages, also of those without chunks."""
    rows = messages_with_conversations(messages, conversations)
    return rows.select(
        F.concat(F.lit("legacy:message:"), "message_id").alias("raw_document_id"),
        filled(F.col("source"), F.lit("legacy")).alias("source"),
        F.lit("legacy_message").alias("source_type"),
        F.col("message_id").cast("string").alias("external_id"),
        F.col("conversation_id").alias("root_document_id"),
        "title",
        F.col("sender_type").alias("author"),
        filled(F.col("timestamp"), F.col("conversation_created_at")).alias("created_at"),
        F.current_timestamp().alias("imported_at"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        filled(F.col("raw_meta"), F.lit("{}")).alias("raw_payload"),
        json_object("model", "sequence", "sub_title", F.lit("legacy_messages").alias("migrated_from")).alias("metadata_json"),
    )


def bootstrap_units(messages: DataFrame, conversations: DataFrame, chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Memory units of older chunks, under their own identifiers so that vectors stay valid."""
    known = messages_with_conversations(messages, conversations).select("message_id")
    rows = chunks.join(known, "message_id")
    now = F.current_timestamp()
    return rows.select(
        F.col("chunk_id").cast("string").alias("memory_unit_id"),
        F.concat(F.lit("legacy:message:"), "message_id").alias("raw_document_id"),
        F.col("chunk_index").alias("unit_index"),
        F.lit("legacy_chunk").alias("unit_type"),
        "content",
        summary(F.col("content")).alias("summary"),
        "start_char",
        "end_char",
        filled(F.col("embedding_version"), F.lit(settings.embedding_model)).alias("embedding_version"),
        json_object(F.lit("legacy_chunks").alias("migrated_from"), F.col("message_id").alias("legacy_message_id")).alias("metadata_json"),
        now.alias("created_at"),
        now.alias("updated_at"),
        "is_embedded",
    )


def rechunked(edited: DataFrame, first_id: int, settings: Settings = Settings()) -> DataFrame:
    """New chunks of edited messages ``(message_id, content)``, numbered after ``first_id``.

    Numbers run within each message and leave room of a million between messages,
    so that no global order is needed; they are unique and larger than before.
    """
    pieces = edited.select("message_id", F.posexplode(chunks_or_whole(F.col("content"), within_text=False)).alias("chunk_index", "c"))
    place = F.dense_rank().over(Window.orderBy("message_id"))  # an edit has one message, or a few
    now = F.current_timestamp()
    return pieces.select(
        (F.lit(first_id) + (place - 1) * 1_000_000 + F.col("chunk_index") + 1).cast("long").alias("chunk_id"),
        "message_id",
        "chunk_index",
        "c.start_char",
        "c.end_char",
        "c.content",
        content_hash(F.col("c.content")).alias("hash"),
        F.lit(settings.legacy_embedding_version).alias("embedding_version"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(0).alias("is_embedded"),
    )
