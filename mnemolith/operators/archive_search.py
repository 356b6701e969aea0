"""Searches and lookups in a store that open only the buckets they need.

A lookup by identifier reads one bucket. A search finds its hits first (from the vector
index where the store has one, else from all vectors), brings at most a page of them to the
driver, and reads the buckets of their documents, at most as many as there are hits.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count
from ..functions.timestamps import normalize_timestamp
from ..settings import Settings
from . import legacy, recall
from .embedding import Embedder
from .store import MemoryStore

HIT = "id string, score double, document string, metadata struct<summary:string,raw_document_id:string>"


class ArchiveSearch:
    """Recall from a store by cosine; ``probes`` is the number of the index's lists that a search goes through, if not what the index measured."""

    def __init__(self, store: MemoryStore, embedder: Embedder, settings: Settings = Settings(), probes: int | None = None, exact: bool = False):
        self.store, self.embedder, self.settings, self.probes, self.exact = store, embedder, settings, probes, exact

    def document(self, raw_document_id: str) -> DataFrame:
        return recall.raw_document(self.store.rows_of("raw_documents", [raw_document_id]), raw_document_id)

    def units(self, raw_document_id: str) -> DataFrame:
        return recall.units_of(self.store.rows_of("memory_units", [raw_document_id]), raw_document_id)

    def chunks(self, message_id: str) -> DataFrame:
        return legacy.chunks_of(self.store.rows_of("chunks", [message_id]), message_id)

    def unit(self, memory_unit_id: str) -> DataFrame:
        """One unit and its document as two nested objects; no row if there is none."""
        units = self.store.rows_of_units("memory_units", [memory_unit_id])
        documents = [r["raw_document_id"] for r in units.select("raw_document_id").collect()]  # one
        return recall.unit_payload(units, self.store.rows_of("raw_documents", documents), memory_unit_id)

    def _hits(self, query: str, k: int) -> DataFrame:
        """The nearest ``k`` vectors: ``id, raw_document_id, score``."""
        vector = self.store.spark.range(1).select(self.embedder.embed_query(query).alias("v")).first()["v"]
        return self.store.nearest_vectors(vector, k, self.embedder.version, self.probes, self.exact)

    def _vectors(self, hits: DataFrame) -> DataFrame:
        """Hits, a page at most, with their vectors' text and metadata, from their documents' buckets."""
        found = {r["id"]: r for r in hits.collect()}
        documents = sorted({r["raw_document_id"] for r in found.values()})
        own = self.store.rows_of("vectors", documents).filter(F.col("id").isin(*found)) if found else self.store.rows_of("vectors", [])
        rows = [(r["id"], found[r["id"]]["score"], r["document"], (r["metadata"]["summary"], r["metadata"]["raw_document_id"])) for r in own.select("id", "document", "metadata").collect()]
        return self.store.spark.createDataFrame(rows, HIT)

    def _traced(self, hits: DataFrame, query: str) -> DataFrame:
        documents = sorted({r["raw_document_id"] for r in hits.select("metadata.raw_document_id").collect()})
        return recall.traced(hits, self.store.rows_of("memory_units", documents), self.store.rows_of("raw_documents", documents), query)

    def memory(self, query: str, limit: int | None = None) -> DataFrame:
        """Hits in order of distance, each with summary, preview and trace."""
        if not query.strip():
            return self._traced(self.store.spark.createDataFrame([], HIT), query)
        hits = self._vectors(self._hits(query, limit or self.settings.default_search_k))
        return self._traced(hits, query).limit(limit or self.settings.max_results_display)

    def page(self, query: str, filters: recall.Filters = recall.Filters()) -> DataFrame:
        """The nearest hits that pass the filters, as many as a page shows, in the order asked for.

        The search widens, twice as many vectors each time, until the page is full or
        there are no more; after four times the filter goes first, over all vectors, which has the
        same result. So a selective filter still fills its page.
        """
        if not query.strip():
            return recall.page_of(self._traced(self.store.spark.createDataFrame([], HIT), query), filters, self.settings)
        size, k = self.settings.max_results_display, self.settings.default_search_k
        plain = filters == replace(recall.Filters(), sort=filters.sort)
        passes = filters.column(normalize_timestamp(F.col("metadata.created_at")), char_count(F.col("document")))
        for _ in range(4):
            hits = self._hits(query, k)
            if plain:
                break
            found = [(r["id"], r["raw_document_id"], r["score"]) for r in hits.collect()]  # k rows
            documents = sorted({d for _, d, _ in found})
            met = {r["id"] for r in self.store.rows_of("vectors", documents).filter(F.col("id").isin(*[i for i, _, _ in found]) & passes).select("id").collect()} if found else set()
            hits = self.store.spark.createDataFrame([x for x in found if x[0] in met][:size], "id string, raw_document_id string, score double")
            if len(met) >= size or len(found) < k:
                break
            k *= 2
        else:
            own = recall.of_version(self.store.table("vectors"), self.embedder.version).filter(passes)
            best = recall.nearest(own, self.embedder.embed_query(query), size)
            hits = best.select("id", F.col("metadata.raw_document_id").alias("raw_document_id"), "score")
        page = recall.page_of(self._traced(self._vectors(hits), query), replace(filters, sort="default"), self.settings)
        return recall.in_order(page, filters.sort)
