"""Tables of the archive, memory and legacy layers."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_s, _i, _l, _t = StringType(), IntegerType(), LongType(), TimestampType()

RAW_DOCUMENTS = _table(
    raw_document_id=_s, source=_s, source_type=_s, external_id=_s, root_document_id=_s, title=_s, author=_s, created_at=_s,
    imported_at=_t, content=_s, content_hash=_s, raw_payload=_s, metadata_json=_s,
)
MEMORY_UNITS = _table(
    memory_unit_id=_s, raw_document_id=_s, unit_index=_i, unit_type=_s, content=_s, summary=_s, start_char=_i, end_char=_i,
    embedding_version=_s, metadata_json=_s, created_at=_t, updated_at=_t, is_embedded=_i,
)
CONVERSATIONS = _table(conversation_id=_s, title=_s, created_at=_s, source=_s, raw_meta=_s)
MESSAGES = _table(
    message_id=_s, conversation_id=_s, sub_title=_s, sender_type=_s, content=_s, content_length=_i, model=_s, content_hash=_s, sequence=_i, timestamp=_s,
)
CHUNKS = _table(
    chunk_id=_l, message_id=_s, chunk_index=_i, start_char=_i, end_char=_i, content=_s, hash=_s, embedding_version=_s, created_at=_t, updated_at=_t, is_embedded=_i,
)
VECTORS = _table(
    id=_s, embedding=ArrayType(DoubleType()), document=_s, embedding_version=_s,
    metadata=_table(memory_unit_id=_s, raw_document_id=_s, title=_s, source=_s, source_type=_s, author=_s, created_at=_s, summary=_s),
)
#: Vectors of texts, for units of equal text and later imports.
EMBEDDINGS = _table(text_hash=_s, embedding_version=_s, embedding=ArrayType(DoubleType()))
#: Which documents an external identifier has.
EXTERNAL_IDS = _table(external_id=_s, source=_s, source_type=_s, raw_document_id=_s)
CONVERSATION_RECORDS = _table(conversation_id=_s, source=_s, title=_s, created_at=_s, raw_meta=_s)
IMPORT_LOGS = _table(import_id=_l, source=_s, file_name=_s, import_time=_t, records_count=_i, status=_s, error_message=_s, notes=_s)

TABLES = {
    "raw_documents": RAW_DOCUMENTS,
    "memory_units": MEMORY_UNITS,
    "conversations": CONVERSATIONS,
    "messages": MESSAGES,
    "chunks": CHUNKS,
    "vectors": VECTORS,
    "embeddings": EMBEDDINGS,
    "external_ids": EXTERNAL_IDS,
    "conversation_records": CONVERSATION_RECORDS,
    "import_logs": IMPORT_LOGS,
}

#: The column by whose hash a table is dealt into buckets; rows that change together share it.
BUCKET_KEYS = {
    "raw_documents": "raw_document_id",
    "memory_units": "raw_document_id",
    "vectors": "metadata.raw_document_id",
    "embeddings": "text_hash",
    "external_ids": "external_id",
    "conversations": "conversation_id",
    "messages": "message_id",
    "chunks": "message_id",
    "conversation_records": "conversation_id",
    "import_logs": "import_id",
}

#: Columns by which single rows are looked up: buckets are sorted by them and carry Bloom filters of them.
LOOKUPS = {"memory_units": ["memory_unit_id"], "vectors": ["id"], "raw_documents": ["raw_document_id"], "messages": ["message_id"], "chunks": ["chunk_id"], "embeddings": ["text_hash"]}
