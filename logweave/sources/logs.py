"""Readers for structured logs, entity labels, id sequences and word vectors."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.columns import anomaly_label
from logweave.operators.ordering import running
from logweave.runtime import broadcast_if_small, materialize

# File names of the id-sequence data set.
ID_FILES = {"train": ("hdfs_train", 0), "test_normal": ("hdfs_test_normal", 0), "test_abnormal": ("hdfs_test_abnormal", 1)}


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    read = (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "\u0000")
        .csv(path)
    )
    strings = [f.name for f in read.schema.fields if f.dataType.typeName() == "string"]
    return read.fillna("", subset=strings)


def read_structured_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header row. Empty strings stay empty strings, never null."""
    return _csv(spark, path, schema)


def read_entity_labels(spark: SparkSession, path: str) -> DataFrame:
    """``BlockId, Label`` file to ``entity_id, label`` with 1 for anomalous entities."""
    read = _csv(spark, path, "BlockId string, Label string")
    return read.select(F.col("BlockId").alias("entity_id"), anomaly_label(F.col("Label")).alias("label"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their 0-based number: files in path order, lines in file order.

    ``monotonically_increasing_id`` follows the lines of each file, so a running number per
    file plus the lengths of the earlier files gives a dense index.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    lengths = lines.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # One short row per file. File names have no numeric order, so this one is plain.
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = running(lines, ["_file"], ["_at"], {"_rn": ("row_number", None)})
    return numbered.join(broadcast_if_small(materialize(offsets)), "_file").select(
        (F.col("_rn") - 1 + F.col("_offset")).alias("line_no"), "value"
    )


def read_id_sequences(
    spark: SparkSession,
    folder: str,
    max_normal: int | None = None,
    max_test_index: int | None = None,
) -> DataFrame:
    """One session per line of whitespace-separated ids, labelled by file.

    Returns ``split, session_id, templates, label``. The test sessions are
    numbered through: normal lines first, abnormal lines after them.
    Everything is read unless the caller gives a cap.
    """
    def load(part: str) -> DataFrame:
        name, label = ID_FILES[part]
        lines = _numbered_lines(spark, posixpath.join(folder, name))
        # File-like splitting: no leading or trailing blanks, and no ids on a blank line.
        ids = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
        return lines.select("line_no", ids.alias("templates"), F.lit(label).alias("label"))

    normal = load("test_normal")
    if max_normal is not None:
        normal = normal.where(F.col("line_no") < max_normal)
    offset = normal.agg(F.count(F.lit(1))).scalar()
    abnormal = load("test_abnormal").withColumn("line_no", F.col("line_no") + offset)
    if max_test_index is not None:
        abnormal = abnormal.where(F.col("line_no") <= max_test_index)
    train = load("train").select(F.lit("train").alias("split"), "*")
    test = normal.unionByName(abnormal).select(F.lit("test").alias("split"), "*")
    return train.unionByName(test).withColumnRenamed("line_no", "session_id")


def read_word_vectors(
    spark: SparkSession, path: str, limit_words: int | None = None
) -> DataFrame:
    """``word v1 .. vd`` lines after a ``count dimension`` header to ``token, vec``.

    All words are read unless ``limit_words`` is given. Stored vectors (a parquet folder with the same columns) are read as they are.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("token", "vec")
    lines = _numbered_lines(spark, path).where(F.col("line_no") > 0)
    if limit_words is not None:
        lines = lines.where(F.col("line_no") <= limit_words)
    parts = F.split(F.rtrim("value"), " ")
    return lines.select(
        F.element_at(parts, 1).alias("token"),
        F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"),
    )
