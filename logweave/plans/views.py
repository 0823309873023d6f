"""Log views over general tables: events, documents and conversations read as structured logs."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.ordering import running
from logweave.operators.vocab import token_vocabulary

# Line ids: document (conversation) number times this, plus the place in it. A place is an int, so it always fits;
# a number too large for the product is an arithmetic error, never another line's id.
PLACES = 1 << 31


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Times in the tables have no zone; one fixed zone keeps epoch arithmetic the same everywhere.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(posixpath.join(folder, f"{name}.parquet"))


def log_events(spark: SparkSession, folder: str) -> DataFrame:
    """``line_id, ts, content, template, label`` plus ``user_id, value``: 20 templates, two entities per line."""
    events = table(spark, folder, "events")
    user = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("line_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(
            F.lit("evt blk_"), user.cast("string"), F.lit(" to blk_-"), (user % 10).cast("string"),
            F.lit(" again blk_"), user.cast("string"),
        ).alias("content"),
        F.concat_ws("_", "event_type", (k % 4).cast("string")).alias("template"),
        ((F.col("event_type") == "error") & (F.col("value") > 20)).cast("int").alias("label"),
        "user_id", "value",
    )


def block_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``entity_id, label_word`` for every entity of ``log_events``: anomalous when its number divides by 7."""
    lines = log_events(spark, folder)
    ids = lines.select(F.explode(F.array(
        F.concat(F.lit("blk_"), F.col("user_id").cast("string")),
        F.concat(F.lit("blk_-"), (F.col("user_id") % 10).cast("string")),
    )).alias("entity_id")).distinct()
    number = F.abs(F.substring("entity_id", 5, 30).cast("long"))
    return ids.withColumn("label_word", F.when(number % 7 == 0, "Anomaly").otherwise("Normal"))


def entity_labels(spark: SparkSession, folder: str) -> DataFrame:
    return block_labels(spark, folder).select(
        "entity_id", (F.col("label_word") == "Anomaly").cast("int").alias("label")
    )


def masked(content: Column) -> Column:
    """The template of a line: the whole line, with numbers masked."""
    return F.regexp_replace(F.trim(content), "[0-9]+", "<*>")


def log_docs(spark: SparkSession, folder: str) -> DataFrame:
    """One log line per non-blank line of each text."""
    docs = table(spark, folder, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_n", "content"))
    return lines.where(F.trim("content") != "").select(
        (F.col("doc_id") * PLACES + F.col("_n")).alias("line_id"), "doc_id", "content",
        masked(F.col("content")).alias("template"),
    )


# Columns that together tell any two order lines apart: the order of the lines is total.
ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity"]


def log_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a long log: the supplier is the entity, flag, status and line number the template."""
    items = table(spark, folder, "lineitem")
    lines = items.select(
        *ITEM_ORDER, F.col("l_suppkey").cast("string").alias("session_id"),
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("template"),
        (F.col("l_quantity") >= 49).cast("int").alias("label"),
    )
    return running(lines, [], ITEM_ORDER, {"line_id": ("row_number", None)}).select("session_id", "line_id", "template", "label")


def conv_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as short sessions of speaker roles."""
    turns = table(spark, folder, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("pos"),
        (F.col("conv_id") * PLACES + F.col("turn").cast("int")).alias("line_id"), F.col("role").alias("template"),
        (F.col("role") == "system").cast("int").alias("label"),
    )


def word_vectors(spark: SparkSession, folder: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """``token, vec``: the embedding whose number is the token's id."""
    if vocabulary is None:
        vocabulary = token_vocabulary(log_docs(spark, folder))
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("int").alias("token_id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    return vocabulary.join(vectors, "token_id").select("token", "vec")


# Dimension of the embeddings table.
VECTOR_DIM = 64
