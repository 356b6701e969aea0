"""Readers of chat exports: one row for each kept message.

The columns are those of ``MESSAGE``, and ``_order``: the file, and the record and
message in it, by which a later reading of a message wins. A conversation's own JSON is not copied
into every message; ``raw_meta`` readers give it once for each conversation. A file of
any size is read by ranges, a conversation at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import filled, strip
from ..functions.timestamps import format_timestamp
from .json_records import json_records

UNTITLED = "Untitled conversation"
OPENAI_SCHEMA = "id string, conversation_id string, title string, create_time variant, mapping map<string,variant>"
GROK_SCHEMA = (
    "conversation struct<id:string,title:string,create_time:variant>,"
    "responses array<struct<response:struct<_id:string,message:string,sender:string,model_slug:variant,create_time:variant>>>"
)
#: Where a record stands: its file, the range of it, and its number in that.
PLACE = ["file", "block", "number"]
#: One export, or several of one form.
Paths = str | list[str]
MESSAGE = [
    "conversation_id", "title", "conversation_created_at", "source", "message_id", "sub_title", "sender_type", "content", "content_length", "model", "sequence", "timestamp",
]


def _openai_records(spark: SparkSession, path: Paths) -> DataFrame:
    """A record for each element of a root array, or the root object itself."""
    return json_records(spark, path, in_array=1, in_object=0)


def _grok_records(spark: SparkSession, path: Paths) -> DataFrame:
    """A record for each element of an array that the root object holds."""
    return json_records(spark, path, in_array=1, in_object=2)


def _slug(value: Column, missing: str) -> Column:
    """A model name: absent gives ``missing``, an explicit null the text ``None``."""
    return F.when(value.isNull(), missing).when(F.is_variant_null(value), "None").otherwise(value.cast("string"))


def read_openai(spark: SparkSession, path: Paths, source: str = "ChatGPT") -> DataFrame:
    """Messages of an export whose root is an array of conversations.

    Nodes keep their order in the file. Parts that are no text are dropped, and
    nodes without text are skipped and take no sequence number.
    """
    conversations = _openai_records(spark, path).select(*PLACE, F.from_json("value", OPENAI_SCHEMA).alias("c")).select(*PLACE, "c.*")
    nodes = conversations.select(*PLACE, "id", "conversation_id", "title", "create_time", F.posexplode("mapping").alias("place", "node_id", "node"))

    def field(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("node", f"$.message.{path}", kind)

    texts = F.filter(field("content.parts", "array<variant>"), lambda part: F.schema_of_variant(part) == "STRING")
    kept = nodes.withColumn("content", F.array_join(F.transform(texts, lambda part: part.cast("string")), "")).filter("content <> ''")
    role = field("author.role")
    order = Window.partitionBy(*PLACE).orderBy("place")
    return kept.select(
        F.coalesce(F.nullif("id", F.lit("")), F.nullif("conversation_id", F.lit("")), F.lit("None")).alias("conversation_id"),
        filled(F.col("title"), F.lit(UNTITLED)).alias("title"),
        format_timestamp(F.col("create_time")).alias("conversation_created_at"),
        F.lit(source).alias("source"),
        filled(field("id"), F.col("node_id")).alias("message_id"),
        F.lit(None).cast("string").alias("sub_title"),
        F.when(role.isin("assistant", "system"), role).otherwise("user").alias("sender_type"),
        "content",
        F.length("content").alias("content_length"),
        _slug(field("metadata.model_slug", "variant"), "unknown").alias("model"),
        (F.row_number().over(order) - 1).alias("sequence"),
        format_timestamp(field("create_time", "variant")).alias("timestamp"),
        F.struct(*PLACE, "place").alias("_order"),
    )


def read_grok(spark: SparkSession, path: Paths, source: str = "Grok") -> DataFrame:
    """Messages of an export whose root object lists conversations and responses.

    The sequence is a response's place, counting those without text too.
    """
    listed = _grok_records(spark, path).select(*PLACE, F.from_json("value", GROK_SCHEMA).alias("c"))
    responses = listed.select(*PLACE, "c.conversation", F.posexplode("c.responses").alias("place", "item")).select(*PLACE, "conversation", "place", "item.response")
    kept = responses.filter(F.coalesce(F.col("response.message"), F.lit("")) != "")
    sender = F.lower(F.coalesce(F.col("response.sender"), F.lit("")))
    return kept.select(
        F.coalesce(F.col("conversation.id"), F.lit("")).alias("conversation_id"),
        filled(F.col("conversation.title"), F.lit(UNTITLED)).alias("title"),
        format_timestamp(F.col("conversation.create_time")).alias("conversation_created_at"),
        F.lit(source).alias("source"),
        F.coalesce(F.col("response._id"), F.lit("None")).alias("message_id"),
        F.lit(None).cast("string").alias("sub_title"),
        F.when(F.contains(sender, F.lit("assistant")) | F.contains(sender, F.lit("bot")), "assistant").otherwise("user").alias("sender_type"),
        F.col("response.message").alias("content"),
        F.length("response.message").alias("content_length"),
        _slug(F.col("response.model_slug"), "unknown").alias("model"),
        F.col("place").alias("sequence"),
        format_timestamp(F.col("response.create_time")).alias("timestamp"),
        F.struct(*PLACE, "place").alias("_order"),
    )


def read_deepseek(spark: SparkSession, path: Paths, source: str = "ChatGPT") -> DataFrame:
    """DeepSeek exports have OpenAI's form, and by default its source name."""
    return read_openai(spark, path, source)


def select_reader(path: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader that the lower-cased path names; ``grok`` goes before ``deepseek``."""
    low = path.lower()
    return read_grok if "grok" in low else read_deepseek if "deepseek" in low else read_openai


def conversation_records(spark: SparkSession, path: Paths) -> DataFrame:
    """Each conversation's own JSON whole, once: ``conversation_id, source, title, created_at, raw_meta, _order``."""
    grok = select_reader(path if isinstance(path, str) else path[0]) is read_grok
    records = (_grok_records if grok else _openai_records)(spark, path).select(*PLACE, F.try_parse_json("value").alias("meta"))
    if grok:
        raw = records.withColumn("meta", F.try_variant_get("meta", "$.conversation", "variant")).filter("meta IS NOT NULL")
    else:
        raw = records

    def field(name: str) -> Column:
        return F.nullif(F.try_variant_get("meta", f"$.{name}", "string"), F.lit(""))

    key = F.coalesce(field("id"), F.lit("")) if grok else F.coalesce(field("id"), field("conversation_id"), F.lit("None"))
    return raw.select(
        key.alias("conversation_id"),
        F.lit("Grok" if grok else "ChatGPT").alias("source"),
        filled(field("title"), F.lit(UNTITLED)).alias("title"),
        format_timestamp(F.try_variant_get("meta", "$.create_time", "variant")).alias("created_at"),
        F.to_json("meta").alias("raw_meta"),
        F.struct(*PLACE).alias("_order"),
    )


def blank_dropped(messages: DataFrame) -> DataFrame:
    """Messages with text besides whitespace, their content stripped; sequences stay."""
    return messages.withColumn("content", strip(F.col("content"))).filter("content <> ''")
