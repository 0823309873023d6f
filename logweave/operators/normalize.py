"""Log families to one schema, and line or session labels from entity labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.columns import (
    ENTITY_PATTERN,
    alert_label,
    compact_timestamp,
    dotted_timestamp,
    entity_ids,
    microsecond_timestamp,
)
from logweave.runtime import broadcast_if_small, materialize


def seconds_since_first(lines: DataFrame, ts: str = "ts", order: str = "line_id") -> DataFrame:
    """Add ``sec``: whole seconds since the first line in file order, truncated toward zero."""
    first = lines.select(F.min_by(F.unix_micros(ts), F.col(order))).scalar()
    micros = F.unix_micros(ts) - first
    whole = F.signum(micros) * F.floor(F.abs(micros) / 1_000_000)
    return lines.withColumn("sec", whole.cast("long"))


def _require_labels(named: DataFrame, labels: DataFrame, on_missing: str) -> None:
    if on_missing not in ("error", "zero"):
        raise ValueError("on_missing must be 'error' or 'zero'")
    if on_missing == "error":
        missing = named.select("entity_id").distinct().join(labels, "entity_id", "left_anti").count()
        if missing:
            raise KeyError(f"{missing} entities have no label")


def line_labels_from_entities(
    lines: DataFrame,
    labels: DataFrame,
    pattern: str = ENTITY_PATTERN,
    on_missing: str = "error",
) -> DataFrame:
    """Set ``label`` to 1 on lines that name at least one anomalous entity, else 0.

    Entities without a label are refused unless ``on_missing`` is ``zero``.

    Only (line, entity) pairs meet the labels, and only the anomalous ones; the
    lines themselves are not multiplied.
    """
    named = lines.select("line_id", F.explode(entity_ids(F.col("content"), pattern)).alias("entity_id"))
    _require_labels(named, labels, on_missing)
    anomalous = materialize(labels.where("label = 1").select("entity_id").distinct())
    hits = named.join(broadcast_if_small(anomalous), "entity_id", "left_semi").select("line_id").distinct()
    # With few anomalous lines the lines themselves need no shuffle.
    flagged = broadcast_if_small(materialize(hits)).withColumn("_hit", F.lit(1))
    return (
        lines.drop("label")
        .join(flagged, "line_id", "left")
        .withColumn("label", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )


def label_sessions(sessions: DataFrame, labels: DataFrame, on_missing: str = "error") -> DataFrame:
    """Attach the entity's label to its session (one row per session).

    ``on_missing='error'`` counts unlabelled sessions first and refuses them. An entity that is listed
    more than once is anomalous when any of its rows says so.
    """
    labels = labels.groupBy("entity_id").agg(F.max("label").alias("label"))
    keyed = labels.withColumnRenamed("entity_id", "session_id")
    _require_labels(sessions.withColumnRenamed("session_id", "entity_id"), labels, on_missing)
    if on_missing == "error":
        return sessions.join(keyed, "session_id")
    return sessions.join(keyed, "session_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


# Output columns of the normalisers.
CANONICAL: Sequence[str] = ("line_id", "ts", "content", "template", "label")


def normalize(
    raw: DataFrame, family: str, labels: DataFrame | None = None, on_missing: str = "error"
) -> DataFrame:
    """Raw structured log to ``line_id, ts, content, template, label``.

    ``family`` is ``hdfs`` (compact time, labels through entities), ``bgl``
    (microsecond time, alert labels) or ``thunderbird`` (dotted date, alert labels).
    """
    if family == "hdfs":
        if labels is None:
            raise ValueError("the hdfs family takes its labels from an entity label table")
        stamped = raw.withColumn("ts", compact_timestamp(F.col("Date"), F.col("Time")))
    elif family == "bgl":
        stamped = raw.withColumn("ts", microsecond_timestamp(F.col("Time")))
    elif family == "thunderbird":
        stamped = raw.withColumn("ts", dotted_timestamp(F.col("Date"), F.col("Time")))
    else:
        raise ValueError(f"unknown log family {family!r}")
    label = F.lit(0) if family == "hdfs" else alert_label(F.col("Label"))
    lines = stamped.select(
        F.col("LineId").cast("long").alias("line_id"),
        "ts",
        F.col("Content").alias("content"),
        F.col("EventTemplate").alias("template"),
        label.alias("label"),
    )
    if family == "hdfs":
        lines = line_labels_from_entities(lines, labels, on_missing=on_missing).select(*CANONICAL)
    return lines
