"""Embedders: anything that turns a text column, or a query, into a vector."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled
from ..functions.vectors import term_counts
from ..settings import Settings


class Embedder(Protocol):
    """``reuse`` says that a vector costs more than finding an earlier one of the same text."""

    version: str
    reuse: bool

    def warm_up(self) -> None: ...

    def embed_column(self, text: Column) -> Column: ...

    def embed_query(self, query: str) -> Column: ...


class TermCountEmbedder:
    """Counts of fixed terms and the text's length; deterministic and inside the JVM."""

    reuse = False

    def __init__(self, terms: Sequence[str], version: str = "term-counts"):
        self.terms, self.version = list(terms), version

    def warm_up(self) -> None:
        """Nothing is loaded."""

    def embed_column(self, text: Column) -> Column:
        return term_counts(text, self.terms)

    def embed_query(self, query: str) -> Column:
        return term_counts(F.lit(query), self.terms)


class SentenceModelEmbedder:
    """L2-normalised sentence vectors; the model is loaded once in each Python worker."""

    reuse = True

    def __init__(self, model: str, batch: int = 32):
        self.version, self.batch = model, batch

    def warm_up(self) -> None:
        """Load the model in the workers, one short text each, so that the first search does not wait for it."""
        spark = SparkSession.active()
        workers = spark.sparkContext.defaultParallelism
        spark.range(0, workers, 1, workers).select(self.embed_column(F.lit("warm"))).write.format("noop").mode("overwrite").save()

    def embed_column(self, text: Column) -> Column:
        name, size = self.version, self.batch

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from sentence_transformers import SentenceTransformer  # only where it is installed

            model = SentenceTransformer(name)
            for texts in batches:
                yield pd.Series(list(model.encode(texts.tolist(), batch_size=size, normalize_embeddings=True)))

        return embed(text)

    def embed_query(self, query: str) -> Column:
        """The query's vector as a literal, so that the model runs once and not for every row searched."""
        row = SparkSession.active().range(1).select(self.embed_column(F.lit(query)).alias("embedding")).first()
        return F.array(*[F.lit(float(x)) for x in row["embedding"]])


_shared: dict[str, Embedder] = {}


def resolve_embedder(given: Embedder | None = None, settings: Settings | None = None) -> Embedder:
    """The embedder given, or else the session's shared one of the configured sentence model; its model loads on first use."""
    if given is not None:
        return given
    model = (settings or Settings()).embedding_model
    return _shared.setdefault(model, SentenceModelEmbedder(model))


def vectors(units: DataFrame, embedder: Embedder) -> DataFrame:
    """Vector rows of units that have their ``document`` with them: id, embedding, text, version and metadata."""
    return vector_rows(units.withColumn("embedding", embedder.embed_column(F.col("content"))), embedder.version)


def vector_rows(units: DataFrame, version: str) -> DataFrame:
    """Vector rows of units that have an ``embedding`` and their ``document``."""
    metadata = F.struct(
        "memory_unit_id",
        "raw_document_id",
        filled(F.col("document.title"), F.lit("Untitled document")).alias("title"),
        F.col("document.source").alias("source"),
        F.col("document.source_type").alias("source_type"),
        F.coalesce("document.author", F.lit("")).alias("author"),
        F.coalesce("document.created_at", F.lit("")).alias("created_at"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )
    return units.select(F.col("memory_unit_id").alias("id"), "embedding", F.col("content").alias("document"), F.lit(version).alias("embedding_version"), metadata.alias("metadata"))


def text_hash(text: Column) -> Column:
    """What tells texts apart where their vectors are kept."""
    return F.sha2(text.cast("binary"), 256)


def reused_vectors(units: DataFrame, known: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """Vectors of the texts that ``known`` lacks, and the known ones that count.

    ``known`` holds ``text_hash, embedding_version, embedding``; only those of the embedder's
    version count. Each text that is new is embedded once, however many units have it.
    """
    own = known.filter(F.col("embedding_version") == embedder.version)
    texts = units.select(text_hash(F.col("content")).alias("text_hash"), "content")
    unseen = texts.join(own.select("text_hash"), "text_hash", "left_anti").dropDuplicates(["text_hash"])
    return unseen.select("text_hash", F.lit(embedder.version).alias("embedding_version"), embedder.embed_column(F.col("content")).cast("array<double>").alias("embedding")), own
