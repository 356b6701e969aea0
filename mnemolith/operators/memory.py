"""From messages to archived documents and from those to memory units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunks_or_whole
from ..functions.text import content_hash, filled, json_object, memory_unit_id, raw_document_id, summary


def raw_documents(messages: DataFrame, source_type: str = "conversation_message") -> DataFrame:
    """Archive rows of messages whose content is stripped and not blank; ``_order``, where messages have it, stays."""
    source = filled(F.col("source"), F.lit("unknown"))
    external = F.col("message_id").cast("string")
    message = [c for c in messages.columns if c not in ("title", "conversation_created_at", "source", "conversation_id", "_order")]
    order = ["_order"] if "_order" in messages.columns else []
    return messages.select(
        raw_document_id(source, F.lit(source_type), external).alias("raw_document_id"),
        source.alias("source"),
        F.lit(source_type).alias("source_type"),
        external.alias("external_id"),
        F.nullif(F.col("conversation_id").cast("string"), F.lit("")).alias("root_document_id"),
        "title",
        F.col("sender_type").alias("author"),
        filled(F.col("timestamp"), F.col("conversation_created_at")).alias("created_at"),
        F.current_timestamp().alias("imported_at"),
        "content",
        content_hash(F.col("content")).alias("content_hash"),
        json_object(*message).alias("raw_payload"),
        json_object("model", "sequence", "sub_title").alias("metadata_json"),
        *order,
    )


def memory_units(documents: DataFrame, embedding_version: str, unit_type: str = "chunk", with_document: bool = False) -> DataFrame:
    """Retrievable units of archive rows; a text too short to cut is one unit.

    ``with_document`` adds what vectors need of the document as a column ``document``, so
    that these need no join.
    """
    facts = [document_facts().alias("document")] if with_document else []
    pieces = documents.select(
        "raw_document_id",
        *facts,
        json_object("source", "source_type", "title", "author", "created_at").alias("metadata_json"),
        F.posexplode(chunks_or_whole(F.col("content"))).alias("unit_index", "unit"),
    )
    now = F.current_timestamp()
    return pieces.select(
        memory_unit_id(F.col("raw_document_id"), F.col("unit_index")).alias("memory_unit_id"),
        "raw_document_id",
        "unit_index",
        F.lit(unit_type).alias("unit_type"),
        "unit.content",
        summary(F.col("unit.content")).alias("summary"),
        "unit.start_char",
        "unit.end_char",
        F.lit(embedding_version).alias("embedding_version"),
        "metadata_json",
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(0).alias("is_embedded"),
        *(["document"] if with_document else []),
    )


def document_facts() -> Column:
    """What a vector's metadata hold of its document."""
    return F.struct("source", "source_type", "title", "author", "created_at")


def unit_counts(units: DataFrame) -> DataFrame:
    """Units and characters of each document."""
    return units.groupBy("raw_document_id").agg(F.count("*").alias("units"), F.sum(F.length("content")).alias("chars"))


def import_counters(documents: DataFrame, units: DataFrame) -> DataFrame:
    """One row: documents and units of an import."""
    return documents.agg(F.count("*").alias("raw_documents")).crossJoin(units.agg(F.count("*").alias("memory_units")))
