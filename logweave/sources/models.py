"""Fitted models on disk: versions of a model by kind, each whole or not there.

A version is a folder with the model, its vocabulary and a record (kind, form, parameters). It is written first; then a small
file that names the current version is replaced in one step. A reader follows that file, so it never sees half a model, and a
writer that fails leaves the old version current. Two writers get versions of their own, and the later one is current.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, SparkSession

from logweave.sources import files


@dataclass
class Loaded:
    """A model (a table, or a ``pyspark.ml`` model) with its parameters, vocabulary and number of version."""

    model: object
    kind: str
    version: int
    params: dict = field(default_factory=dict)
    vocabulary: DataFrame | None = None


def save(model: DataFrame | MLWritable, root: str, kind: str, params: Mapping, vocabulary: DataFrame | None = None) -> int:
    """Store a table of a fit or a ``pyspark.ml`` model as the next version of ``kind`` below ``root``; its number."""
    spark = model.sparkSession if isinstance(model, DataFrame) else SparkSession.getActiveSession()
    place = posixpath.join(root, kind)
    number = 1 + (_current(spark, place) or {"version": 0})["version"]
    # A name of its own for every writer.
    folder = f"version-{number}-{uuid.uuid4().hex[:8]}"
    path = posixpath.join(place, folder)
    form = "table" if isinstance(model, DataFrame) else "ml"
    if form == "table":
        model.write.parquet(posixpath.join(path, "model"))
    else:
        model.write().save(posixpath.join(path, "model"))
    if vocabulary is not None:
        vocabulary.write.parquet(posixpath.join(path, "vocabulary"))
    record = {"kind": kind, "form": form, "version": number, "params": dict(params), "vocabulary": vocabulary is not None, "folder": folder}
    files.write_text(spark, posixpath.join(place, "CURRENT"), json.dumps(record, sort_keys=True, default=str))
    return number


def load(spark: SparkSession, root: str, kind: str) -> Loaded:
    """The current version of ``kind``; a ``FileNotFoundError`` where there is none."""
    place = posixpath.join(root, kind)
    record = _current(spark, place)
    if record is None:
        raise FileNotFoundError(f"no model of kind {kind!r} below {root}")
    path = posixpath.join(place, record["folder"])
    at = posixpath.join(path, "model")
    model = spark.read.parquet(at) if record["form"] == "table" else DefaultParamsReader.loadParamsInstance(at, spark)
    vocabulary = spark.read.parquet(posixpath.join(path, "vocabulary")) if record["vocabulary"] else None
    return Loaded(model, record["kind"], record["version"], record["params"], vocabulary)


def _current(spark: SparkSession, place: str) -> dict | None:
    text = files.read_text(spark, posixpath.join(place, "CURRENT"))
    return None if text is None else json.loads(text)
