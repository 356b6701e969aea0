"""Recall: the nearest units of a query, traced to their documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_count, filled, parsed_json, preview, summary
from ..functions.timestamps import normalize_timestamp
from ..functions.vectors import cosine_distance
from ..settings import Settings
from .embedding import Embedder

SORTS = ("default", "time_asc", "time_desc")


def nearest(vectors: DataFrame, query: Column, k: int, distance: Callable[[Column, Column], Column] = cosine_distance, digits: int | None = None) -> DataFrame:
    """The ``k`` rows of ``vectors(id, embedding, …)`` nearest to ``query``.

    Exact: every partition keeps its best ``k``, so the plan is a top-k and not a
    sort. Equal distances go by ``id``; with ``digits`` those that are equal to so many
    decimals count as equal, which makes the order independent of rounding. Vectors that
    are null, zero (by cosine), of another length or not all numbers have no distance: they
    go last and are then dropped.
    """
    found = distance(F.col("embedding"), query)
    scored = vectors.withColumn("score", found if digits is None else F.round(found, digits))
    return scored.orderBy(F.asc_nulls_last("score"), "id").limit(k).filter(F.col("score").isNotNull() & ~F.isnan("score"))


def of_version(vectors: DataFrame, version: str) -> DataFrame:
    """The vectors that an embedder made; those of another have no meaning beside them."""
    return vectors.filter(F.col("embedding_version") == version) if "embedding_version" in vectors.columns else vectors


@dataclass(frozen=True)
class Filters:
    sort: str = "default"
    min_length: int = 0
    start_date: str = ""
    end_date: str = ""

    @staticmethod
    def parse(given: Mapping[str, object]) -> Filters:
        """Unknown sorts, and lengths that are no whole number, give the defaults."""
        sort = str(given.get("sort", "default"))
        try:
            least = max(0, int(str(given.get("min_length") or 0)))
        except ValueError:
            least = 0
        dates = [str(given.get(name) or "").strip() for name in ("start_date", "end_date")]
        return Filters(sort if sort in SORTS else "default", least, *dates)

    def column(self, timestamp: Column, chars: Column) -> Column:
        """Dates compare as text and inclusively; a row without one passes."""
        day = F.substring(F.coalesce(timestamp, F.lit("")), 1, 10)
        met = chars >= self.min_length
        if self.start_date:
            met = met & ((day == "") | (day >= self.start_date))
        if self.end_date:
            met = met & ((day == "") | (day <= self.end_date))
        return met


def raw_document(documents: DataFrame, raw_document_id: str) -> DataFrame:
    """The document of that identifier; no row if there is none."""
    return documents.filter(F.col("raw_document_id") == raw_document_id)


def units_of(units: DataFrame, raw_document_id: str) -> DataFrame:
    """A document's units in their order."""
    return units.filter(F.col("raw_document_id") == raw_document_id).orderBy("unit_index")


def detail(units: DataFrame, documents: DataFrame, few: bool = False, more: Sequence[str] = ()) -> DataFrame:
    """Units, with ``more`` of their columns, and the facts of their documents; units without one are dropped.

    ``few`` says that the units are a page of hits: they are broadcast, so that no
    document moves.
    """
    facts = documents.select(
        "raw_document_id", "source", "source_type", "external_id", "root_document_id", "title", "author", "created_at", "imported_at",
        F.col("content").alias("raw_content"), "content_hash", "raw_payload", F.col("metadata_json").alias("raw_metadata_json"),
    )
    own = units.select(
        "memory_unit_id", "raw_document_id", "unit_index", "unit_type", F.col("content").alias("memory_content"), "summary", "start_char", "end_char", "embedding_version",
        F.col("metadata_json").alias("memory_metadata_json"), *more,
    )
    return facts.join(F.broadcast(own), "raw_document_id") if few else own.join(facts, "raw_document_id")


def search_memory(units: DataFrame, documents: DataFrame, vectors: DataFrame, query: str, embedder: Embedder, limit: int | None = None, settings: Settings = Settings(), distance=cosine_distance, prefilter: Column | None = None, digits: int | None = None) -> DataFrame:
    """Hits of ``query`` in order of distance, each with summary, preview and trace.

    Without a limit the nearest ``default_search_k`` are searched and
    ``max_results_display`` of them shown. Hits whose unit is gone are dropped after the
    search. ``prefilter`` restricts the vectors before it instead. Vectors of another
    embedder's version are no hits.
    """
    searched = of_version(vectors, embedder.version)
    searched = searched if prefilter is None else searched.filter(prefilter)
    if not query.strip():
        searched = searched.limit(0)
    hits = nearest(searched, embedder.embed_query(query), limit or settings.default_search_k, distance, digits)
    return traced(hits, units, documents, query).limit(limit or settings.max_results_display)


def traced(hits: DataFrame, units: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """Vector rows with their ``score``, at most a page of them, traced to units and documents, in order."""
    hits = hits.select(F.col("id").alias("memory_unit_id"), "score", F.col("document").alias("hit_document"), F.col("metadata.summary").alias("hit_summary"))
    # The hits are k rows at most, a proven bound for both broadcasts: first their units are found, then these units' documents.
    chosen = units.join(F.broadcast(hits), "memory_unit_id")
    found = detail(chosen, documents, few=True, more=["score", "hit_document", "hit_summary"])
    trace = F.struct("raw_document_id", "external_id", "root_document_id", "start_char", "end_char")
    shown = found.select(
        "memory_unit_id",
        "score",
        F.coalesce("hit_document", "memory_content").alias("content"),
        filled(F.col("hit_summary"), F.col("summary"), summary(F.col("memory_content"))).alias("summary"),
        preview(F.col("memory_content"), query).alias("preview"),
        "source",
        "source_type",
        filled(F.col("title"), F.lit("Untitled document")).alias("title"),
        F.coalesce("author", F.lit("")).alias("author"),
        normalize_timestamp(F.col("created_at")).alias("created_at"),
        "raw_document_id",
        trace.alias("trace"),
    )
    return shown.orderBy("score", "memory_unit_id")


def search(units: DataFrame, documents: DataFrame, vectors: DataFrame, query: str, embedder: Embedder, filters: Filters = Filters(), settings: Settings = Settings(), distance=cosine_distance, prefilter: bool = False, digits: int | None = None) -> DataFrame:
    """The nearest ``default_search_k``, then filtered, sorted and cut to what is displayed.

    ``prefilter`` filters before the search, so that a selective filter still
    fills the page.
    """
    before = None
    if prefilter:
        before = filters.column(normalize_timestamp(F.col("metadata.created_at")), char_count(F.col("document")))
    hits = search_memory(units, documents, vectors, query, embedder, settings.default_search_k, settings, distance, before, digits)
    return page_of(hits, filters, settings)


def page_of(hits: DataFrame, filters: Filters, settings: Settings = Settings()) -> DataFrame:
    """Traced hits, filtered, sorted and cut to what is displayed."""
    page = hits.select(
        F.col("memory_unit_id").alias("chunk_id"),
        "content",
        "preview",
        "title",
        "source",
        F.col("created_at").alias("timestamp"),
        F.col("raw_document_id").alias("message_id"),
        char_count(F.col("content")).alias("char_count"),
        "score",
    ).filter(filters.column(F.col("timestamp"), F.col("char_count")))
    return in_order(page, filters.sort).limit(settings.max_results_display)


def in_order(page: DataFrame, sort: str) -> DataFrame:
    """A page's rows by distance, or by time and then distance."""
    rank = ["score", "chunk_id"]
    return page.orderBy(*{"default": rank, "time_asc": [F.asc("timestamp"), *rank], "time_desc": [F.desc("timestamp"), *rank]}[sort])


def unit_payload(units: DataFrame, documents: DataFrame, memory_unit_id: str) -> DataFrame:
    """One unit and its document as two nested objects; no row if there is none."""
    row = detail(units.filter(F.col("memory_unit_id") == memory_unit_id), documents, few=True)
    unit = F.struct(
        "memory_unit_id", "raw_document_id", "unit_index", "unit_type", F.col("memory_content").alias("content"), "summary", "start_char", "end_char", "embedding_version",
        parsed_json(F.col("memory_metadata_json")).alias("metadata"),
    )
    document = F.struct(
        "raw_document_id", "source", "source_type", "external_id", "root_document_id", "title", "author",
        normalize_timestamp(F.col("created_at")).alias("created_at"), normalize_timestamp(F.col("imported_at").cast("string")).alias("imported_at"),
        F.col("raw_content").alias("content"), "content_hash", parsed_json(F.col("raw_metadata_json")).alias("metadata"), parsed_json(F.col("raw_payload")).alias("raw_payload"),
    )
    return row.select(unit.alias("memory_unit"), document.alias("raw_document"))


def as_response(query: str, hits: DataFrame) -> DataFrame:
    """One row of JSON: query, count and results in order (hits are a page, so bounded)."""
    listed = hits.agg(F.sort_array(F.collect_list(F.struct("score", "memory_unit_id", F.struct(*hits.columns).alias("hit")))).alias("all"))
    results = F.transform("all", lambda x: x["hit"])
    return listed.select(F.to_json(F.struct(F.lit(query).alias("query"), F.size("all").alias("count"), results.alias("results")), {"ignoreNullFields": "false"}).alias("body"))
