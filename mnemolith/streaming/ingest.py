"""Incremental ingestion: a stream of export files or messages into the store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.embedding import Embedder
from ..operators.memory import raw_documents
from ..operators.store import MemoryStore
from ..sources.chat_exports import blank_dropped, conversation_records, select_reader


def ingest_export(spark: SparkSession, path: str, store: MemoryStore, embedder: Embedder, supersede: bool = False) -> dict[str, int]:
    """Read one export, archive its messages and return the counters."""
    messages = blank_dropped(select_reader(path)(spark, path))
    return store.ingest(raw_documents(messages), embedder, supersede, conversation_records(spark, path))


def ingest_stream(messages: DataFrame, store: MemoryStore, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Archive a stream of messages as it grows, each batch as one version.

    A version names the stream (by its checkpoint) and the batch, so a batch that comes
    again after a failure is skipped if it was stored.
    """

    def store_batch(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.ingest(raw_documents(blank_dropped(batch)), embedder, batch=(checkpoint, number))

    return messages.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_exports(spark: SparkSession, folder: str, store: MemoryStore, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Archive export files as they appear in a folder; files read before are skipped.

    All files of a batch, of whatever form, are one version, which names the batch.
    """
    form = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(form).option("pathGlobFilter", "*.json").load(folder).select("path")

    def store_files(batch: DataFrame, number: int) -> None:
        store_paths(spark, [row["path"] for row in batch.toLocalIterator()], store, embedder, (checkpoint, number))  # names of files only

    return files.writeStream.foreachBatch(store_files).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_paths(spark: SparkSession, paths: list[str], store: MemoryStore, embedder: Embedder, batch: tuple[str, int] | None = None) -> dict[str, int]:
    """Archive export files of any forms as one version; later files win, as the order of readings says."""
    documents, records = [], []
    for reader in dict.fromkeys(map(select_reader, paths)):
        some = sorted(p for p in paths if select_reader(p) is reader)
        documents.append(raw_documents(blank_dropped(reader(spark, some))))
        records.append(conversation_records(spark, some))
    if not documents:
        return {"raw_documents": 0, "memory_units": 0}
    return store.ingest(reduce(DataFrame.unionByName, documents), embedder, records=reduce(DataFrame.unionByName, records), batch=batch)
