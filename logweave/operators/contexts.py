"""Contexts of the next event: the last events of a window, as text, and what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context(order: int) -> Column:
    """The last ``order`` real events of a window, as text."""
    start = F.greatest(F.col("length") - (order - 1), F.lit(1))
    return F.array_join(F.slice("ids", start, F.least(F.col("length"), F.lit(order))).cast("array<string>"), " ")


def suffixes(context_col: str) -> Column:
    """The context without its oldest events, longest first, down to a single event."""
    events = F.split(context_col, " ")
    return F.when(F.col(context_col) != "", F.transform(
        F.sequence(F.lit(1), F.size(events)),
        lambda i: F.array_join(F.slice(events, i, F.size(events)), " "),
    )).otherwise(F.array().cast("array<string>"))


def next_event_counts(windows: DataFrame, order: int) -> DataFrame:
    """``context, next_id, n`` for contexts of 0 .. order events.

    Full contexts are counted first; the shorter ones add up those counts, so
    windows are not multiplied.
    """
    full = windows.select(context(order).alias("full"), "next_id").groupBy("full", "next_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    every = F.concat(suffixes("full"), F.array(F.lit("")))
    return full.select(F.explode(every).alias("context"), "next_id", "n").groupBy("context", "next_id").agg(
        F.sum("n").alias("n")
    )
