"""The corpus pipeline: five operators applied one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's input. All but the last
return the columns of ``docs``; the last adds ``shard``.

Null and empty texts fail the quality rules and leave at the first stage; a
null ``doc_id`` is kept at the second unless its text is a near copy of another's;
equal rows leave one; extra columns go through unchanged; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemolith.llm.decontamination import uncontaminated
from mnemolith.llm.mixing import mixed
from mnemolith.llm.near_dedup import distinct_documents
from mnemolith.llm.quality_rules import accepted, learn_rules
from mnemolith.llm.sharding import even_tree, sharded
from mnemolith.llm.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base test or a learnt rule rejects."""
    return accepted(docs, learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of five-word shingle sets that reach 0.8."""
    return distinct_documents(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item with at most 20 % edits."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_edits=0.2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that sources meet their target weights."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row its shard of 24."""
    return sharded(docs, even_tree(24))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: No SQL: the quality rules and the walks behind decontamination are learnt or drawn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
