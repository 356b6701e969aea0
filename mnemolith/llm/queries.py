"""Registered queries of the corpus operators, with production parameters.

Each query reads its whole tables and derives the columns of its contract from
the operator's general result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import language_id, language_model, quality_classifier, toxicity
from .conversation_repair import damaged, repaired
from .decontamination import contamination
from .divergence import divergence
from .language_model import held_out
from .licences import scan_licences
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .oracles import ORACLE_SQL
from .quality_rules import judged, learn_rules
from .sharding import even_tree, shard_rows
from .substring_dedup import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents against every item of benchmark, 20 % edits allowed."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), max_edits=0.2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to 150 % of all words, weights 3, 1, 2."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels of three quarters of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").filter(~out))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, and where they would be with one more."""
    return shard_rows(_table(spark, sf_dir, "documents"), even_tree(24))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents by sentence rules."""
    found = scan_licences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ", ").alias("licences"), F.array_join("sentence_ids", ", ").alias("sentence_ids"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 35-word windows removed from every text of documents."""
    docs = _table(spark, sf_dir, "documents")
    return remove_repeats(docs, width=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from the labels of four fifths of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    langs, tables = language_id.train(docs.filter(~out))
    found = language_id.identify(docs.drop("lang"), langs, tables)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the learnt decision list's verdict for all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, _table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingle sets reach 0.85."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and trie scores of all documents, learnt from six sevenths of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7, 2)
    return language_model.score_texts(docs, ~out).withColumn("held_out", out)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged, and the cheapest repair of each."""
    return repaired(damaged(_table(spark, sf_dir, "conversations")))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels of three quarters of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels").filter(~out))
    scored = quality_classifier.score_texts(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language against each other, and each source's own terms."""
    return divergence(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_licences": op5_licences,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_dedup": op9_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
