"""Stored session data sets, run records and the feature cache."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources import files


def write_sessions(lines: DataFrame, params: Mapping, path: str) -> None:
    """Store session lines by split, and the split parameters next to them."""
    lines.write.mode("overwrite").partitionBy("split").parquet(posixpath.join(path, "sessions"))
    spark = lines.sparkSession
    text = json.dumps(dict(params), sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(
        posixpath.join(path, "params")
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(path, "sessions"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(posixpath.join(path, "params"))


def session_summary(lines: DataFrame) -> DataFrame:
    """Sessions and the anomalous share per split; one anomalous line makes a session anomalous."""
    sessions = lines.groupBy("split", "session_id").agg(F.max("label").alias("label"))
    return sessions.groupBy("split").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg((F.col("label") > 0).cast("double")).alias("anomalous_share"),
    )


def run_id(params: Mapping) -> str:
    """First eight hex digits of the md5 of the sorted parameters."""
    return hashlib.md5(json.dumps(dict(params), sort_keys=True, default=str).encode()).hexdigest()[:8]


def append_results(
    metrics: DataFrame, params: Mapping, model: str, path: str, train_seconds: float, test_seconds: float
) -> None:
    """Append one record per metrics row to the results table."""
    record = metrics.select(
        F.current_timestamp().alias("recorded_at"),
        F.lit(run_id(params)).alias("run_id"),
        F.lit(model).alias("model"),
        F.lit(json.dumps(dict(params), sort_keys=True, default=str)).alias("params"),
        F.to_json(F.struct(*metrics.columns)).alias("metrics"),
        F.lit(float(train_seconds)).alias("train_seconds"),
        F.lit(float(test_seconds)).alias("test_seconds"),
    )
    record.coalesce(1).write.mode("append").parquet(path)


def input_fingerprint(df: DataFrame) -> str:
    """Text that changes with the files that ``df`` is read from: their paths, lengths and times of change.

    ``df`` is a table read from files. Only the files' names and sizes are looked at, once per file.
    """
    of_file = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    number = F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")
    count, total = of_file.agg(F.count(F.lit(1)), F.sum(number)).first()
    return f"{count}:{total or 0}"


def cached_features(
    spark: SparkSession, cache_dir: str, params: Mapping, build: Callable[[], DataFrame], inputs: Sequence[DataFrame] = ()
) -> DataFrame:
    """Stored features for these parameters and the present files of ``inputs``, built and written on the first call.

    A changed input gets an entry of its own. An entry is written aside and put in place as a whole: a write that did not finish
    leaves nothing that is read, and of two builders at once the first one's entry stays.
    """
    key = {**params, "_inputs": [input_fingerprint(df) for df in inputs]} if inputs else params
    path = posixpath.join(cache_dir, run_id(key))
    if not files.exists(spark, path):
        aside = posixpath.join(cache_dir, f"_building-{uuid.uuid4().hex}")
        build().write.parquet(aside)
        files.publish(spark, aside, path)
    return spark.read.parquet(path)
