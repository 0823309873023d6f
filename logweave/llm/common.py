"""Helpers of the operators: input tables, stored steps, and functions that run on Arrow batches."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.runtime import discard, materialize

__all__ = ["discard", "map_batches", "rows_of", "store", "table", "transform_text", "unused"]

# Rows of one batch handed to Python: bounds the memory of a task whatever the length of its texts.
BATCH_BYTES = 8 << 20

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(folder, f"{name}.parquet"))


def store(df: DataFrame) -> DataFrame:
    """A stored copy in the shared checkpoint folder: a lost executor never repeats the steps before it."""
    return materialize(df, "zstd")


def _slices(batches: Batches) -> Batches:
    """The same rows in batches of about ``BATCH_BYTES``; a longer row is a batch of its own."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, BATCH_BYTES)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, function: Callable[[Batches], Batches], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    return df.mapInArrow(lambda batches: function(_slices(batches)), schema)


def rows_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch from lists or numpy arrays, in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def transform_text(
    docs: DataFrame,
    needed: dict[str, str],
    function: Callable[[list, dict[str, list]], dict[str, list]],
    added: dict[str, str],
    text: str = "text",
) -> DataFrame:
    """Run ``function`` on the texts of every batch; keep every other column of ``docs``.

    ``needed`` maps a key to a column that is read and dropped. ``function`` gets the texts and those columns and
    returns the columns of ``added`` (name to Spark type), which replace equally named ones; the key ``text``
    replaces the texts.
    """
    extra = [f for f in T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in added.items())).fields if f.name != text]
    gone = {n.lower() for n in [*needed.values(), *[f.name for f in extra]]}
    kept = [f for f in docs.schema.fields if f.name.lower() not in gone]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*kept, *extra]])
    names, place = docs.columns, {f.name: docs.columns.index(f.name) for f in kept}
    which = docs.columns.index(text)
    inputs = {k: names.index(c) for k, c in needed.items()}

    def run(batches: Batches) -> Batches:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = function(batch.column(which).to_pylist(), {k: batch.column(i).to_pylist() for k, i in inputs.items()})
            columns = [
                pa.array(out[f.name], f.type) if f.name in out else batch.column(place[f.name])
                for f in arrow
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(arrow, columns)]))

    return map_batches(docs, run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def null_safe_ids(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows that can take part in cross-document work."""
    return docs.where(F.col(column).isNotNull())
